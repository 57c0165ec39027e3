"""Small tables with the awkward cases, and helpers, shared by the tests of this folder."""

import random

WORDS = [f"w{i}" for i in range(400)] + ["é", "ß,", "a-b", "Ωmega", "x" * 30]


def texts(seed=0, n=60):
    """Random texts with exact copies, shared passages, periodic and degenerate texts."""
    rnd = random.Random(seed)
    passage = " ".join(rnd.choices(WORDS, k=70))
    out = []
    for i in range(n):
        body = " ".join(rnd.choices(WORDS, k=rnd.randint(0, 120)))
        if i % 5 == 1:
            cut = rnd.randint(0, len(body))
            body = body[:cut] + " " + passage[rnd.randint(0, 60):] + "\n" + body[cut:]
        if i % 7 == 3 and out:
            body = rnd.choice(out) or body
        if i % 11 == 4 and out:
            near = (rnd.choice(out) or "").split(" ")
            near[rnd.randrange(len(near))] = "edit"
            body = " ".join(near)
        out.append(body)
    out += [None, "", " \t\n", "one", "a " * 150, "aaaa" * 200, "aaaa" * 200, "ab" * 300, "\x00\x01 " * 30]
    rnd.shuffle(out)
    return out


def documents(spark, rows):
    """rows: (doc_id, text); with columns whose names operators use inside."""
    full = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t), "x", 1) for i, t in rows]
    return spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                       "bucket string, rid int")


def enumerated(spark, values):
    return documents(spark, list(enumerate(values)))


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}
