import random
import re

from pyspark.sql import functions as F

from linework.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, source string, found string, rank int")


def test_base_spans(spark):
    rng = random.Random(7)
    bits = ["password", "PassWD", "api_key", "apikey", "token", "secret", ":", "=", " ", "  ", '"', "'", "abc", "abcdef123", "AKIA", "AKIA" + "Z9" * 9, "0a" * 12, "deadbeef", "é", "𝄞", "\n", "ſecret=abcdefg", "K"]
    rows = [(i, "".join(rng.choices(bits, k=rng.randrange(0, 40))), f"s{i % 9}") for i in range(300)]
    rows += [(900, None, None), (901, "", "s"), (902, "token=abcdef " * 3000, "s"), (None, "password: hunter22", None), (901, "token: 'zyxwvut1'", "s")]
    got = secrets.scan(table(spark, rows)).collect()
    assert len(got) == len(rows)
    left = [(i, base(t)) for i, t, _ in rows]
    for r in got:
        own = [(x.start, x.rank, x.end) for x in r.found if x.rank < 3]
        assert (r.doc_id, own) in left, r
        left.remove((r.doc_id, own))


def test_ownership_separates_examples_from_credentials(spark):
    mine, example = "Zq81-kfLm20_xPvWc7Rt", "Ab3dEf6hIj9kLm2nOp5q"
    rows = [(i, f"see {example} for use", f"s{i}") for i in range(6)]
    rows += [(10, f"key {mine} here", "s1"), (11, f"again {mine}", "s1"), (12, f'token = "{mine}"', "s1"), (13, "password=changeme", "s2"), (14, "abcdefghijklmnopqrstuvwxyz", "s3")]
    got = {r.doc_id: [(x.rank, x.start, x.end, x.live) for x in r.found] for r in secrets.scan(table(spark, rows)).collect()}
    assert all(got[i] == [] for i in (*range(6), 14))
    assert got[10] == [(3, 4, 24, True)] and got[11] == [(3, 6, 26, True)]
    assert got[12] == [(0, 0, 29, True)]  # the base span stays, the run inside adds nothing
    many = [(i, "password=changeme", f"s{i}") for i in range(5)]
    assert {x.live for r in secrets.scan(table(spark, many)).collect() for x in r.found} == {False}


def test_owner_and_repository_are_parameters(spark):
    rows = [(i, "token=sametoken", f"s{i}") for i in range(5)]
    one = secrets.scan(table(spark, rows), repo=F.col("source"), owner=F.lit("me")).collect()
    assert {(x.repos, x.owners, x.live) for r in one for x in r.found} == {(5, 1, True)}


def test_empty(spark):
    assert secrets.scan(table(spark, [])).count() == 0


def test_listing(spark):
    r = secrets.scan(table(spark, [(1, "AKIA" + "A" * 16 + " token=abcdef", "s")])).select(secrets.listing(F.col("found")).alias("x")).first()
    assert r.x == "access:0:20,assign:21:33"
