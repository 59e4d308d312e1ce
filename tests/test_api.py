"""Library paths outside the registered queries: strict/permissive JSON lines, required document
content, caller batch models."""

import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import chunk as K
from quarry.sources import files as SRC


def test_jsonl_strict_and_permissive(spark):
    d = tempfile.mkdtemp(prefix="quarry-jsonl-test-")
    with open(os.path.join(d, "part.json"), "w") as f:
        f.write('{"title": "a", "chunk_id": 1, "content": "x", "source": "s"}\n{broken\n')
    with pytest.raises(Exception):
        SRC.read_jsonl(spark, d, strict=True).collect()
    rows = SRC.read_jsonl(spark, d, strict=False).collect()
    assert len(rows) == 2 and rows[1]["_corrupt_record"] == "{broken"


def test_documents_need_content(spark):
    ok = spark.createDataFrame([("t", 1, "body", None)], "title string, chunk_id int, content string, source string")
    r = K.to_documents(ok).first()
    assert r["page_content"] == "body" and r["metadata"]["source"] == "" and r["metadata"]["chunk_id"] == "1"
    bad = spark.createDataFrame([("t", 1, None, "s")], "title string, chunk_id int, content string, source string")
    with pytest.raises(Exception):
        K.to_documents(bad).collect()


def test_embed_with_caller_batch_model(spark):
    df = spark.createDataFrame([(i, "w" * i) for i in range(50)], "id int, text string")

    def model(texts):
        return np.array([[len(t), 1.0, 0.0] for t in texts])

    out = {r["id"]: list(r["embedding"]) for r in K.embed_batches(df, "text", model, 3).collect()}
    assert out[7] == [7.0, 1.0, 0.0] and len(out) == 50
