import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lumenflow.llm.exact_dedup import exact_dedup

SCHEMA = "doc_id long, text string, size long, kept string"


def brute(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for i, r in enumerate(rows)}
    out = []
    for i, r in enumerate(rows):
        same = [k for k in norm if norm[k] == norm[i]]
        ids = [rows[k][0] for k in same if rows[k][0] is not None]
        out.append((r[0], min(ids) if ids else None, len(same), hashlib.sha256(norm[i].encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(5, "a b", 1, "x"), (3, "a\t b", 1, None), (4, "a  b ", 1, ""), (None, "a\nb", 1, ""), (9, None, 1, ""), (8, "", 1, ""), (7, "é" * 9000, 1, ""), (6, "é" * 9000, 1, ""), (6, "é" * 9000, 1, ""), (1, "c", 1, "")]


@pytest.mark.parametrize("digest", [F.md5, lambda c: F.substring(F.md5(c), 1, 2), lambda c: F.lit("00")])
def test_equal_to_brute_force_even_with_colliding_digests(spark, digest):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = exact_dedup(df, content_hash=digest).collect()
    assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=str) == brute(ROWS)
    assert sum(r["kept"] for r in got) == len({x[3] for x in brute(ROWS)})
    assert all(r["kept"] for r in got if r["group_size"] == 1)


def test_empty_table(spark):
    assert exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
