import ctypes
import re
from pathlib import Path

import numpy as np
import pytest

from docsluice.llm import base, mixing, overlap
from docsluice.llm import tokens as T
from tests.llm.test_tokens import PATH, library


@pytest.fixture
def no_lists(spark, monkeypatch):
    """Tables of lists of rows, which start a second kind of Python worker on executors, are errors."""

    def fail(*_, **__):
        raise AssertionError("a list of rows goes through Python workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", fail)


def test_labels_need_no_list_of_rows(spark, no_lists):
    links = spark.sql("SELECT * FROM VALUES (1L, 2L), (2L, 3L), (7L, 9L) AS t(a, b)")
    roots = overlap.labels(links, None)
    assert {tuple(r) for r in roots.collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (9, 7)}
    more = overlap.labels(spark.sql("SELECT 3L AS a, 9L AS b"), roots)
    assert {tuple(r) for r in more.collect()} == {(1, 1), (2, 1), (3, 1), (7, 1), (9, 1)}


@pytest.mark.parametrize("cells", [[], [("src0", "en", "code", 0.5), (None, "de", "other", 1.0)]])
def test_cells_need_no_list_of_rows(spark, no_lists, cells):
    out = mixing.probabilities(spark, mixing.Fit(cells, 0, 0.0))
    assert [tuple(r) for r in out.collect()] == cells
    assert out.dtypes == [("source", "string"), ("lang", "string"), ("topic", "string"), ("probability", "double")]


def test_an_encoder_of_a_shared_worker_remembers_less():
    e = T.Encoder(PATH, 50)
    text = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(400))
    assert np.frombuffer(e(text), dtype=e.dtype).tolist() == library(text)
    assert len(e.seen) <= 50 and len(e.known) <= 50


def test_freed_memory_goes_back_to_the_system():
    def held() -> float:
        return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    if not Path("/proc/self/smaps_rollup").exists() or not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("neither Linux nor glibc")
    blocks = [bytes(1000) for _ in range(100_000)]
    last = [blocks[k] for k in range(0, 100_000, 1000)]  # so the C library can't shrink its heap from the top
    del blocks
    before = held()
    base.give_back()
    assert len(last) == 100 and before - held() > 50
