import random

import pandas as pd
from pyspark.sql import functions as F

from lawstrata.operators import orphans

REF = "relation string, k string, first_us bigint, ref_field string, row_key string, ref_value string, ref_month string"
KEY = "relation string, k string, deleted boolean, first_us bigint"


def brute(refs, keys):
    at = {(r, k): (d, f) for r, k, d, f in keys if k is not None}
    out = []
    for rel, k, first, field, row, value, month in refs:
        if k is None:
            continue
        d, f = at.get((rel, k), (None, None))
        status = "missing" if (rel, k) not in at else "deleted" if d else "late" if f is not None and f > (2**62 if first is None else first) else None
        if status:
            out.append((field, row, value, status, month))
    return sorted(out, key=repr)


def case(n, hot=0.0, seed=1):
    rng = random.Random(seed)
    keys = [(rng.choice("ab"), f"k{i}", rng.random() < 0.2, rng.randint(0, 100)) for i in range(n)]
    keys = list({(r, k): (r, k, d, f) for r, k, d, f in keys}.values())
    refs = [("a" if rng.random() < hot else rng.choice("ab"), "k0" if rng.random() < hot else f"k{rng.randint(0, 2 * n)}", rng.randint(0, 100), "f", f"r{i}", f"v{i}", "2024-01") for i in range(3 * n)]
    return refs, keys


def test_against_brute_force(spark, rows):
    refs, keys = case(300)
    refs += [("a", None, 1, "f", "n", None, None), ("zz", "k1", None, "f", "n", "v", None), ("a", "k1", None, "f", None, "v", "x")]
    got = rows(orphans.find_orphans(spark.createDataFrame(refs, REF), spark.createDataFrame(keys, KEY)))
    assert got == brute(refs, keys)


def test_hot_key_is_salted(spark, rows):
    refs, keys = case(200, hot=0.6)
    got = rows(orphans.find_orphans(spark.createDataFrame(refs, REF), spark.createDataFrame(keys, KEY), per_range=40))
    assert got == brute(refs, keys)


def test_empty_tables(spark, rows):
    refs, keys = case(5)
    r, k = spark.createDataFrame(refs, REF), spark.createDataFrame(keys, KEY)
    assert rows(orphans.find_orphans(r, k.limit(0))) == brute(refs, [])
    assert orphans.find_orphans(r.limit(0), k).count() == 0
    assert orphans.count_orphans(orphans.find_orphans(r, k.limit(0))).agg(F.sum("n_refs")).first()[0] == len(refs)


def test_equal_hashes():
    targets = pd.DataFrame({"pid": 1, "side": 0, "h": [5, 5, 5], "k": ["a", "b", "c"], "deleted": [False, True, False], "first_us": [0, 0, 9], "ref_field": None, "row_key": None, "ref_value": None, "ref_month": None})
    refs = pd.DataFrame({"pid": 1, "side": 1, "h": 5, "k": list("abcd"), "deleted": False, "first_us": 1, "ref_field": "f", "row_key": list("abcd"), "ref_value": "v", "ref_month": "m"})
    out = pd.concat(orphans._probe(iter([targets, refs])))
    assert dict(zip(out.row_key, out.ref_status)) == {"b": "deleted", "c": "late", "d": "missing"}
