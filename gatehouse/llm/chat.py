"""Chat formatting by columnar byte assembly.

A batch of turns is laid out at once: lengths of the header, content and closing segments, their cumulative offsets,
and scatter indices in numpy copy all of them into one preallocated buffer, which becomes an Arrow string column
without another copy. The loss mask is the byte range of each assistant text.

Template of a turn: `[ROLE]` role `[/ROLE]` text, then `</s>`, or for a role other than assistant `[INST]` … `[/INST]`
around the text; a conversation begins with `<s>`. Inside roles and texts a backslash is doubled, and a backslash is put
after the first character of every control string, so no text holds one and unescaping gives back every byte.

Rows are ordered by (conv_id, turn, role, text), nulls first: ties and repeated rows are kept in that order. Null text or
role counts as empty. conv_id null is a conversation of its own. An empty table gives no rows. A conversation of any length
passes through its task as a stream: what is kept is hash states and one turn. Turns are laid out in passes of about a megabyte; a longer
turn is a pass of its own, whose segments are copied whole, so it needs a few times its own size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatehouse.llm import common

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]")
BEGIN, END = "<s>", "</s>"
_UNESCAPE = re.compile(r"\\(\\?)")
LEARNED = "assistant"
#: What a turn counts for in a pass beside its role and text.
TURN_BYTES = 64
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
TURNS = "conv_id long, turn long, role string, formatted string, loss_start int, loss_end int"


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROL:  # none of them begins within another
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text) if "\\" in text else text


def _escaped(column: pa.Array) -> pa.Array:
    """The column with control strings escaped; only rows that hold a character of concern are touched."""
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    odd = pc.match_substring_regex(column, r"\\|<s>|</s>|\[/?INST\]|\[/?ROLE\]")
    made = pa.array([escape(column[i].as_py()) for i in np.flatnonzero(odd).tolist()], column.type)
    return made if len(made) == len(column) else pc.replace_with_mask(column, odd, made) if len(made) else column


def parse(text: str) -> tuple[str, str, bool]:
    """Role, text and whether it is learned, of a formatted turn; control strings stand nowhere but where the template has them."""
    at = len(BEGIN) if text.startswith(BEGIN) else 0
    role_end = text.index("[/ROLE]", at)
    body, role = role_end + len("[/ROLE]"), text[at + len("[ROLE]") : role_end]
    asked = text.startswith("[INST]", body)
    if not text.startswith("[ROLE]", at) or not text.endswith("[/INST]" if asked else END):
        raise ValueError("not a formatted turn")
    return unescape(role), unescape(text[body + len("[INST]") : -len("[/INST]")] if asked else text[body : -len(END)]), not asked


def assemble(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Concatenates, row by row, segment columns given as (bytes, offsets). Returns the bytes, the row offsets, and each segment's start by row."""
    lengths = np.stack([np.diff(off) for _, off in parts], axis=1)  # rows x segments
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    starts = ends - lengths
    out = np.empty(int(ends[-1, -1]) if ends.size else 0, np.uint8)
    for k, (data, off) in enumerate(parts):
        if len(data) > common.PASS_BYTES:  # few long segments: no index for each byte
            for a, b, to in zip(off[:-1].tolist(), off[1:].tolist(), starts[:, k].tolist(), strict=True):
                out[to : to + b - a] = data[a:b]
        elif len(data):
            out[np.arange(len(data), dtype=np.int64) + np.repeat(starts[:, k] - off[:-1], lengths[:, k])] = data
    return out, np.concatenate([[0], ends[:, -1]]) if ends.size else np.zeros(1, np.int64), starts


def _pick(options: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A segment column that has options[which[i]] in row i."""
    sizes = np.array([len(x) for x in options], np.int64)
    table, first = np.frombuffer(b"".join(options), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    lengths = sizes[which]
    off = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return table[np.arange(off[-1]) + np.repeat(first[which] - off[:-1], lengths)], off


def format_batch(ids: pa.Array, turns: pa.Array, roles: pa.Array, texts: pa.Array, first: np.ndarray) -> pa.RecordBatch:
    """Formatted turns of a batch. first: whether a row begins its conversation."""
    import pyarrow.compute as pc

    learned = np.asarray(pc.fill_null(pc.equal(roles, LEARNED), False), bool)
    parts = [
        _pick([b"[ROLE]", BEGIN.encode() + b"[ROLE]"], first.astype(int)),
        common.utf8(_escaped(roles)),
        _pick([b"[/ROLE][INST]", b"[/ROLE]"], learned.astype(int)),
        common.utf8(_escaped(texts)),
        _pick([b"[/INST]", END.encode()], learned.astype(int)),
    ]
    data, offsets, starts = assemble(parts)
    formatted = pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    begin = np.where(learned, starts[:, 3] - offsets[:-1], 0).astype(np.int32)
    end = np.where(learned, starts[:, 4] - offsets[:-1], 0).astype(np.int32)
    return pa.RecordBatch.from_arrays([ids, turns, roles.cast(pa.string()), formatted.cast(pa.string()), pa.array(begin), pa.array(end)], names=["conv_id", "turn", "role", "formatted", "loss_start", "loss_end"])


def _format(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches come ordered by conversation."""
    before: object = _format
    for whole in batches:
        for lo, hi in common.passes(common.utf8(whole.column(2))[1] + common.utf8(whole.column(3))[1] + TURN_BYTES * np.arange(whole.num_rows + 1)):
            b = whole.slice(lo, hi - lo)
            ids = b.column(0).to_pylist()
            first = np.array([x != y for x, y in zip(ids, [before, *ids], strict=False)], bool)
            before = ids[-1]
            yield format_batch(*b.columns[:4], first)


def format_turns(conversations: DataFrame) -> DataFrame:
    """A row for each turn, in order within its partition, with the formatted text and the byte range under the loss mask."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.repartition(common.partitions(conversations.sparkSession), "conv_id")
    return rows.sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_format, TURNS)


def _digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads formatted turns back: parses them by the template, unescapes, and hashes turns and what the mask covers."""
    now: object = _digest
    state: list = []
    out = []

    def close():
        n, turns, chars, loss, size = state
        out.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    def made():
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split()[0] for x in DIGESTS.split(", ")])

    for b in batches:
        for conv, scalar, lo, hi in zip(b.column(0).to_pylist(), b.column(3), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
            raw = scalar.as_buffer()
            text = str(raw, "utf-8", "surrogatepass")
            if text.startswith(BEGIN):
                if state:
                    close()
                    if len(out) >= 4096:
                        yield made()
                        out = []
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[4] += len(text)
            role, text, said = parse(text)
            state[0] += 1
            state[1].update(f"{role}\n".encode("utf-8", "surrogatepass"))
            state[1].update(text.encode("utf-8", "surrogatepass"))
            state[1].update(b"\n")
            del text  # a turn may be long
            if said:
                learned = unescape(str(raw[lo:hi], "utf-8", "surrogatepass"))
                state[2] += len(learned)
                state[3].update(learned.encode("utf-8", "surrogatepass"))
    if state:
        close()
    if out:
        yield made()


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    return format_turns(rows.unionByName(extra)).mapInArrow(_digest, DIGESTS)
