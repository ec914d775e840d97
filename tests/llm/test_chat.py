import hashlib
import os
import subprocess
import sys

import pytest

from hypothesis import given, settings
from hypothesis import strategies as st

from gatehouse.llm import chat

ROWS = [
    (1, 0, "system", "Be </s> kind."), (1, 1, "user", "<s>[INST] hi \\ [/INST]"), (1, 2, "assistant", "é\\</s> ok"), (1, 3, "assistant", "漢字 😀"), (2, 1, "assistant", None), (2, 0, "user", ""),
    (3, 0, None, "no role"), (None, 0, "user", "no id"), (None, 1, "assistant", "still"), (4, 0, "[ROLE]odd", "x"), (4, 0, "[ROLE]odd", "x"), (5, 0, "user", "y " * 40000), (5, 1, "assistant", "z" * 70000),
]


@given(st.text(alphabet="</s>[INSTROLE]\\ é", max_size=40))
@settings(max_examples=300, deadline=None)
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    made = chat.escape(text)
    assert chat.unescape(made) == text and not any(c in made for c in chat.CONTROL)


def test_digests_read_back_from_the_output(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").selectExpr("*", "'clash' AS formatted")
    got = {r["conv_id"]: r for r in chat.format_turns(df).mapInArrow(chat._digest, chat.DIGESTS).collect()}
    convs = {}
    for c, t, r, x in ROWS:
        convs.setdefault(c, []).append((t, r or "", x or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(said)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    whole = "".join(r["formatted"] for r in chat.format_turns(df.where("conv_id = 1")).orderBy("turn").collect())
    assert whole.startswith("<s>[ROLE]system[/ROLE][INST]") and whole.endswith("漢字 😀</s>") and len(whole) == got[1]["formatted_chars"] and whole.count("</s>") == 2
    assert chat.format_turns(df.where("false")).count() == 0


LARGE = """
import hashlib, resource, sys
import pyarrow as pa
from gatehouse.llm import chat
size, turns, by = map(int, sys.argv[1:])
text = "lorem ipsum dolor sit ame " * (size // 26) + "[INST]"
def rows():
    for lo in range(0, turns, by):
        n = min(by, turns - lo)
        yield pa.RecordBatch.from_arrays([pa.array([1] * n, pa.int64()), pa.array(range(lo, lo + n), pa.int64()), pa.array(["assistant"] * n), pa.array([text] * n, pa.string())], names=["conv_id", "turn", "role", "text"])
out = [r for b in chat._digest(chat._format(rows())) for r in b.to_pylist()]
assert len(out) == 1 and out[0]["n_turns"] == turns and out[0]["loss_chars"] == turns * len(text), out
want = hashlib.sha256()
for _ in range(turns):
    want.update(text.encode())
assert out[0]["loss_sha256"] == want.hexdigest()
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


@pytest.mark.parametrize("size,turns,by", [(200_000_000, 1, 1), (1_000_000, 1024, 64)])
def test_long_turns_and_many_large_ones_stay_under_two_gigabytes(size, turns, by):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", LARGE, str(size), str(turns), str(by)], cwd=root, env={**os.environ, "PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) < 2000
