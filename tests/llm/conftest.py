import random

import pytest

from .helpers import DOCUMENTS


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Awkward documents: copies, near copies, shared passages, nulls, empty and long texts,
    repeated rows, personal data."""
    rng = random.Random(7)
    base, passage = prose(rng, 120), prose(rng, 70)
    words = base.split()
    out = [(i, prose(rng, rng.randint(1, 90))) for i in range(20)]
    out += [(20 + i, base) for i in range(6)]
    for i in range(30):
        copy = list(words)
        for _ in range(rng.randint(1, 6)):
            copy[rng.randrange(len(copy))] = prose(rng, 1)
        out.append((30 + i, " ".join(copy)))
    out += [(70 + i, f"{prose(rng, 40)} {passage} {prose(rng, 30)}") for i in range(5)]
    out += [(80, None), (81, ""), (82, " \n\t "), (83, "one"), (84, "ONE"), (85, "é" * 300), (86, "ab " * 3000), (87, prose(rng, 6000)), (88, "x" * 50_000), (None, base), (None, None)]
    out += [(90, "Mail a.b@c-d.example.org, 10.0.0.255 or 1.2.3.256; card 4111 1111 1111 1111 and +1 (555) 010-9999."), (91, "a@b.c@d.e_f@g.h 1.2.3.4.5.6.7.8 +12 4111-1111-1111-1112"), (90, "again, another text")]
    out += [(92, "The iban of this account is DE89370400440532013000 and ssn 123-45-6789. token = b44e15e09fd311c3cf3163b66d5a9875b883d8ce"), (3, out[3][1])]
    return [(d, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "B", None]) if i % 3 else "hot", None if t is None else len(t)) for i, (d, t) in enumerate(out)]


@pytest.fixture(scope="session")
def documents(spark, rows):
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def clashing(spark, rows):
    """The documents under more columns, named like what operators use inside."""
    from pyspark.sql import functions as F

    more = ["k1", "k2", "rep", "n", "h", "u", "key", "term", "pos", "slot", "shard", "size", "score", "__id", "pii", "target",
            "__text", "__m_email", "__g_ip", "__l_card", "__b_phone", "__slot", "__source", "__key", "__pos", "c0", "c1", "digest", "path"]
    return spark.createDataFrame(rows, DOCUMENTS).withColumns({c: F.lit(i) for i, c in enumerate(more)})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
