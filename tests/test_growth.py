"""What keeps the fold's cost in step with its input: searches by stem, slices of batches, calls condensed where they lie."""

import random
import re

import pyarrow as pa

from quillsieve import constants as C
from quillsieve.operators import condense, textops
from quillsieve.plans.queries import QUERIES

PIECES = [*re.findall("[A-Za-z -]+", C.SIGNAL_WORDS), "Error", "fooError", "Error2", "Warning", "FAIL", "fail:", "ERR!", "not ok", "exit code 7", "E   x", "e", "  ", "\t", "✗ one", "❯", "×", "é", "ſ", " ", "_", "1", "İ"]


def test_stem_search_finds_what_the_patterns_find():
    rnd = random.Random(3)
    lines = ["".join(rnd.choice(PIECES) + rnd.choice(["", " ", ":"]) for _ in range(rnd.randint(0, 4))) for _ in range(4000)]
    lines += [line.swapcase() for line in lines[:1000]]
    assert textops.signal_mask(lines) == [textops.is_signal(line) for line in lines]
    for *_, pattern in C.CENSUS:
        assert textops.matched(lines, pattern) == [bool(textops._re(pattern).search(line)) for line in lines]
    for line in lines:
        assert textops.holds(line, C.FAILURE_WORDS) == bool(textops._re("(?m)" + C.FAILURE).search(line))


def test_hash_is_the_loop_over_units():
    for text in ("", "a", "trim" * 999, "é√ 日本 😀" * 77, "\ud800x"):
        h, raw = 2166136261, text.encode("utf-16-le", "surrogatepass")
        for low, high in zip(raw[::2], raw[1::2]):
            h = (h ^ (low | high << 8)) * 16777619 & 0xFFFFFFFF
        assert textops.fnv1a(text) == f"{h:x}"


def test_batches_are_cut_by_bytes():
    texts = ["x" * 300_000 if k % 3 else None for k in range(200)] + ["y" * 9_000_000, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(202)), pa.array(texts)], names=["doc_id", "text"])
    parts = list(condense.slices(batch, 1))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert max(sum(len(t or "") for t in p.column(1).to_pylist()) for p in parts) <= 9_000_000 + condense.SLICE_BYTES and len(parts) > 8


def _plan(spark, sf, name):
    return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_block_gate_deals_no_texts(spark, sf):
    plan = _plan(spark, sf, "block_gate")
    assert plan.index("Exchange hashpartitioning") < plan.index("md5(cast(out")


def test_runtimes_condense_calls_where_they_lie(spark, sf):
    plan = _plan(spark, sf, "runtime_routes")
    assert "Join" not in plan and "HashAggregate" not in plan and plan.count("Exchange hashpartitioning") <= 4
