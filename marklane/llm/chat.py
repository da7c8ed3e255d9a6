"""Chat formatting with a grammar round trip.

Grammar of the rendered text, turn after turn:

    user       [INST] TEXT [/INST]
    system     [SYS] TEXT [/SYS]
    assistant  [OUT] TEXT</s>
    other      [TURN ROLE] TEXT [/TURN]     (ROLE in hexadecimal UTF-8, "-" for null)

The parser is deterministic: an opening mark fixes the closing mark, and TEXT
ends at its first occurrence and holds no bare control string. A turn is rendered as it is and parsed again; if
what comes back is not the source, its control strings are escaped and the
turn is rendered anew, until both are identical. Escaping puts one more
backslash after the first character of a control string, and reading takes one
away, so texts that hold escaped control strings themselves survive too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, map_rows

OPEN = {"user": "[INST] ", "system": "[SYS] ", "assistant": "[OUT] "}
CLOSE = {"user": " [/INST]", "system": " [/SYS]", "assistant": "</s>"}
_CONTROL = r"/?INST\]|/?SYS\]|OUT\]|/?TURN[\] ]"
_PLAIN = re.compile(rf"(\[)(\\*)(?={_CONTROL})|(<)(\\*)(?=/?s>)")
_ESCAPED = re.compile(rf"(\[)\\(\\*)(?={_CONTROL})|(<)\\(\\*)(?=/?s>)")
_BARE = re.compile(rf"\[(?={_CONTROL})|<(?=/?s>)")
_OTHER = re.compile(r"\[TURN ([0-9a-f]*|-)\] ")


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: (m[1] or m[3]) + "\\" + (m[2] or m[4] or ""), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: (m[1] or m[3]) + (m[2] or m[4] or ""), text)


@dataclass
class Turn:
    role: str | None
    text: str  # as rendered, still escaped
    loss: tuple[int, int]  # span of the rendered text under the loss mask, relative to the turn


def marks(role: str | None) -> tuple[str, str]:
    if role in OPEN:
        return OPEN[role], CLOSE[role]
    name = "-" if role is None else role.encode("utf-8", "surrogatepass").hex()
    return f"[TURN {name}] ", " [/TURN]"


def parse(rendered: str) -> list[Turn]:
    """The turns of a rendered text; raises ValueError where the grammar ends."""
    out, at = [], 0
    while at < len(rendered):
        role = next((r for r, o in OPEN.items() if rendered.startswith(o, at)), None)
        if role:
            begin, close = at + len(OPEN[role]), CLOSE[role]
        elif m := _OTHER.match(rendered, at):
            role = None if m[1] == "-" else bytes.fromhex(m[1]).decode("utf-8", "surrogatepass")
            begin, close = m.end(), " [/TURN]"
        else:
            raise ValueError(f"no turn starts at {at}")
        end = rendered.find(close, begin)
        if end < 0:
            raise ValueError(f"the turn at {at} does not end")
        if _BARE.search(rendered, begin, end):
            raise ValueError(f"the turn at {at} holds a bare control string")
        span = (begin - at, end - at) if role == "assistant" else (0, 0)
        out.append(Turn(role, rendered[begin:end], span))
        at = end + len(close)
    return out


def render(role: str | None, text: str | None) -> str:
    """One turn, escaped only if it would not come back otherwise. Null texts are empty; null roles stay null."""
    text = text or ""
    start, end = marks(role)
    content = text
    for _ in range(3):
        rendered = start + content + end
        try:
            back = parse(rendered)
        except ValueError:
            back = []
        if len(back) == 1 and back[0].role == role and unescape(back[0].text) == text:
            return rendered
        content = escape(content)
    raise ValueError("a turn cannot be rendered reversibly")


def format_turns(turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Append ``formatted``, the rendered turn, and loss_from and loss_to, its span of code points under the loss mask.

    A conversation's text is its turns' texts in order, with nothing between:
    each turn parses by itself, so no row needs its neighbours and a
    conversation of any length needs no more memory than its longest turn.
    Null texts are rendered as empty ones, null and unknown roles by marks of their own; repeated rows are turns of their own, an empty table gives
    none. Columns named formatted, loss_from or loss_to are replaced, all others stay.
    """
    r, t = turns.columns.index(role), turns.columns.index(text)

    def make():
        def fn(batch: pa.RecordBatch):
            out, lo, hi = [], [], []
            for a, b in zip(batch.column(r).to_pylist(), batch.column(t).to_pylist(), strict=True):
                out.append(render(a, b))
                begin = len(marks(a)[0])
                lo.append(begin if a == "assistant" else 0)
                hi.append(len(out[-1]) - len(marks(a)[1]) if a == "assistant" else 0)
            return [pa.array(out, pa.string()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())]

        return fn

    return map_rows(turns, make, [field("formatted", T.StringType()), field("loss_from", T.LongType()), field("loss_to", T.LongType())], text)


def digest(formatted: DataFrame, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """Read conversations back from rendered turns: key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Rows of a key are sorted and streamed through running hashes, so a long
    conversation is never held. Ties in ``order`` follow the rendered text; null
    orders come first; a null key is a conversation like any other.
    """
    names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, started, state = None, False, None

        def done():
            n, turns, chars, loss, size = state
            return current, n, turns.hexdigest(), chars, loss.hexdigest(), size

        for batch in batches:
            rows = []
            for k, text, lo, hi in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if not started or k != current:
                    if started:
                        rows.append(done())
                    current, started, state = k, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for turn in parse(text):
                    said = unescape(turn.text)
                    state[0] += 1
                    state[1].update(f"{turn.role or ''}\n{said}\n".encode())
                    if turn.loss != (0, 0):
                        masked = unescape(text[lo:hi])
                        state[2] += len(masked)
                        state[3].update(masked.encode())
                state[4] += len(text)
            yield _rows(rows, names, k_type)
        if started:
            yield _rows([done()], names, k_type)

    kind = formatted.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    k_type = to_arrow_type(kind)
    schema = T.StructType([T.StructField(key, kind), *[T.StructField(n, T.LongType() if n in ("n_turns", "loss_chars", "formatted_chars") else T.StringType()) for n in names[1:]]])
    ordered = formatted.select(key, "formatted", "loss_from", "loss_to", order).repartition(key).sortWithinPartitions(F.col(key), F.col(order).asc_nulls_first(), "formatted")
    return ordered.select(key, "formatted", "loss_from", "loss_to").mapInArrow(run, schema)


def _rows(rows: list[tuple], names: list[str], key_type: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)
