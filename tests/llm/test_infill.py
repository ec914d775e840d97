import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gatehouse.llm import infill

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plain(doc_id, text, rate=90, first=20):
    """What the transformation makes of one text."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    i, j = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in infill.SENTINELS) or h[2] % 100 >= rate:
        return doc_id, "plain", n, None, None, text
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    spm = h[3] % 100 < first
    return doc_id, "spm" if spm else "psm", n, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("block", [4, 7, 1 << 18])
def test_kernel_equals_one_text_at_a_time(monkeypatch, block):
    monkeypatch.setattr(infill, "BLOCK_BYTES", block)
    monkeypatch.setattr(infill, "LONG", 5)

    @given(st.lists(st.text(alphabet="abZ é漢😀\n<PSM>", max_size=30), min_size=1, max_size=8), st.integers(0, 10**6))
    @settings(max_examples=150, deadline=None)
    def check(texts, salt):
        ids = [salt + k for k in range(len(texts))]
        h = [hashlib.sha256(f"1:{i}".encode()).hexdigest() for i in ids]
        draws = [np.array([int(x[8 * k : 8 * k + 8], 16) for x in h], np.int64) for k in range(4)]
        got = infill.transform_batch(pa.array(ids), pa.array(texts), draws)
        assert list(zip(*(c.to_pylist() for c in got.columns), strict=True)) == [plain(i, t) for i, t in zip(ids, texts, strict=True)]

    check()


def test_rows_and_round_trip(spark, docs, corpus, odd):
    made = infill.fill_in_middle(docs)
    got = made.withColumn("again", infill.restored(made["form"], made["output"])).collect()
    assert {tuple(r)[:6] for r in got} == {plain(i, t) for i, t, *_ in corpus}
    text = {i: t or "" for i, t, *_ in corpus}
    assert len(got) == len(corpus) and all(r["again"] == text[r["doc_id"]] for r in got)
    assert {r["form"] for r in got} == set(infill.FORMS)
    want = [plain(*r) for r in odd.select("doc_id", "text").collect()]
    assert sorted(str(tuple(r)) for r in infill.fill_in_middle(odd).collect()) == sorted(map(str, want))
    assert infill.fill_in_middle(docs.where("false")).count() == 0


def test_a_long_text_needs_memory_for_its_bytes_alone():
    import tracemalloc

    text = pa.array(["né wörds " * 2_000_000], pa.large_string())
    draws = [np.array([x], np.int64) for x in (12345678, 3456789, 5, 50)]
    tracemalloc.start()
    got = infill.transform_batch(pa.array([1]), text, draws)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    n = got.column(2)[0].as_py()
    size = len("né wörds ".encode()) * 2_000_000
    assert n == len(UNIT.findall("né wörds ")) * 2_000_000 and got.column(1)[0].as_py() == "psm"
    assert peak < 4 * size
