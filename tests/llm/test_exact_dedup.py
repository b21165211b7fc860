import hashlib
import re
import uuid

from driftcurve.llm import exact_dedup as E
from driftcurve.llm.storage import Scratch

SCHEMA = "doc_id bigint, text string, keep_id string, digest int"


def index(spark, path=None):
    return E.DigestIndex(spark, f"index_{uuid.uuid4().hex}", path or Scratch(spark, "t").path("index"), 4)


def run(spark, rows, idx=None):
    return E.exact_dedup(spark.createDataFrame(rows, SCHEMA), idx or index(spark), Scratch(spark, "t"))


def plain(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


TEXTS = ["a b", "a  b", "a\t\r\n\x0b\x0cb", " a b", "a b ", "A b", None, "", "  ", "ä b", "ä b", "x" * 200_000, "x" * 200_000]


def test_equals_brute_force(spark):
    rows = [(100 - i, t, None, None) for i, t in enumerate(TEXTS * 3)]
    got = {r.doc_id: r for r in run(spark, rows).collect()}
    groups = {}
    for i, t, _, _ in rows:
        groups.setdefault(plain(t), []).append(i)
    for i, t, _, _ in rows:
        own = groups[plain(t)]
        assert tuple(got[i]) == (i, min(own), len(own), i == min(own), plain(t))


def test_batches_meet_the_index(spark):
    folder = Scratch(spark, "t").path("index")
    first = index(spark, folder)
    run(spark, [(5, "one", None, None), (6, "two", None, None)], first).collect()
    first.drop()
    again = index(spark, folder)  # another session would know the folder only
    again.attach()
    got = {r.doc_id: r for r in run(spark, [(1, "two", None, None), (2, "three", None, None), (3, "three", None, None)], again).collect()}
    assert (got[1].keep_id, got[1].kept, got[1].group_size) == (6, False, 2) and (got[2].keep_id, got[2].kept, got[3].kept) == (2, True, False)
    assert again.known().count() == 3
    again.drop()


def exchanges_above(plan, scan):
    """How many shuffles lie between a scan of the index and the root of a formatted plan."""
    tree = plan.split("\n\n")[0].split("\n")
    at = next(i for i, x in enumerate(tree) if scan(x))
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    found, d = 0, depth(tree[at])
    for x in reversed(tree[:at]):
        if depth(x) < d:
            d = depth(x)
            found += "Exchange" in x
    return found


def test_the_index_is_read_in_place(spark):
    """Anti-join, groups and look-up join the buckets as they lie: only what is new moves."""
    idx = index(spark)
    scratch = Scratch(spark, "t")
    rows = [(i, f"text {i % 50}", None, None) for i in range(200)]
    run(spark, rows, idx).collect()
    fresh = spark.createDataFrame([(b"x", 1, 1)], "digest binary, keep_id bigint, n_rows bigint")
    for df in (*idx.split(fresh), idx.groups()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Bucketed: true" in plan
        assert exchanges_above(plan, lambda x: "FileScan parquet" in x and "_texts" in x) == 0
        assert plan.count("Exchange") <= 1
    plan = E.resolved(scratch.table(E.digests(spark.createDataFrame(rows, SCHEMA)), "d"), idx, scratch, "least_id")._jdf.queryExecution().executedPlan().toString()
    assert exchanges_above(plan, lambda x: "FileScan parquet" in x and "_texts" in x) == 0
    idx.drop()


def test_batches_of_a_whole_collection(spark):
    rows = [(100 - i, t, None, None) for i, t in enumerate(TEXTS * 5)] + [(None, "a b", None, None), (7, "only here", None, None)]
    idx = index(spark)
    got = sorted(map(tuple, E.exact_dedup_whole(spark.createDataFrame(rows, SCHEMA), idx, Scratch(spark, "t"), 3).collect()), key=repr)
    groups = {}
    for i, t, _, _ in rows:
        groups.setdefault(plain(t), []).append(i)
    low = {k: min(i for i in v if i is not None) for k, v in groups.items()}
    assert got == sorted(((i, low[plain(t)], len(groups[plain(t)]), i == low[plain(t)], plain(t)) for i, t, _, _ in rows), key=repr)
    assert idx.spark.table(idx.again).count() > 0
    idx.drop()


def test_query_leaves_no_table_behind(spark):
    before = spark.catalog.listTables()
    assert E.op8_exact_dedup(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert spark.catalog.listTables() == before


def test_edge_cases(spark):
    assert run(spark, []).count() == 0
    rows = [(None, "a", None, None), (None, "a", None, None), (None, "b", None, None), (4, "b", None, None), (4, "b", None, None)]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in run(spark, rows).collect()), key=repr)
    assert got == sorted([(None, None, 2, True)] * 2 + [(None, 4, 3, False)] + [(4, 4, 3, True)] * 2, key=repr)
