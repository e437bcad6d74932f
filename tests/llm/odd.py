"""Small tables with all that a stage must stand: nulls, empty and long texts, ties, repeated rows,
columns with clashing names."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, digest string, "
          "key string, size int, shard int, hub string, score double, place long, _digest string, "
          "_repeat int, _id long, _copy int, _place int, _hit string, row string, id string, "
          "copies int, own string, hit string, items string, `a.b` string")
OWN = ("dig", 7, 70, 8, 80, "hit", "row", "id", 9, "own", "h", "it", "dot")  # clash with names inside


def rows(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["The", "THE", "É", "é", "ß", "x-y", "a.b,"]

    def text(n):
        return "".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "\r\n", ". "])
                       for _ in range(n))

    passage = " ".join(f"p{i}" for i in range(45))
    base = [text(n) for n in (0, 1, 2, 5, 30, 60, 200, 3000)]
    texts = base + [base[5]] * 6 + [base[4].upper(), "", "", " \t\n", None, None, "one", "x " * 400]
    texts += [f"{text(8)} {passage} {text(8)}" for _ in range(6)] + [passage, passage + " " + passage]
    out = []
    for i, t in enumerate(texts):
        out.append((i * 3 % 40, t, rng.choice(["en", None]), rng.choice(["a", "b", "Z", None, ""]),
                    None, "clash", None, 7, 1, "h", 0.5, 3, *OWN))
    out += [out[9], out[9], out[24], (None, base[5], None, None, None) + out[0][5:],
            (None, "only here", None, "a", None) + out[0][5:], (None, None, None, None, None) + out[0][5:]]
    return out


def frame(spark, seed=1):
    return spark.createDataFrame(rows(seed), SCHEMA)


def empty(spark):
    return frame(spark).limit(0)
