"""Chat formatting: schema fingerprints select mappings that turn records into canonical turns; a template formats them.

A record is a JSON object. Its fingerprint is a hash of the sorted set of its nested field paths (`messages[].role`).
Each mapping states, as data, the paths it needs and may have, and how turns are made of them; the fingerprints of all
its path sets are known in advance, so a record is mapped by one lookup. A record with further paths falls back to the
mapping that needs the most of those it has; one that fits none gives no turns (layouts() reports it).

The template marks each turn as `<|im_start|>role\\ntext<|im_end|>\\n`. Inside roles and texts every `<`, `[` and
backslash is followed by a backslash (a line end inside a role becomes backslash n), so that no control string of this
or another template (`</s>`, `[INST]`) survives in a text, and reading takes it back exactly. The loss mask covers the
text of each assistant turn.

A conversation is kept as one row per turn, never gathered: read_back() streams sorted rows with running digests.

Defined results: a null text or role is empty; turns with equal numbers are ordered by their place in the record, then
by the formatted turn; null numbers come first; a null conversation id is a conversation; repeated rows are turns each;
a null record, one that is no JSON or is nested too deep for the JSON parser gives no turns; fields nested deeper than a
mapping's do no harm; texts of any length are formatted whole, a turn at a time; an empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from purselight.llm.common import map_batches

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LOSS_ROLE = "assistant"
_ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "ai": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Mapping:
    """turns: steps ("say", role, paths) for texts joined by a blank line, ("turn", role path, text path) for one turn,
    or ("each", list path, role field, text field) for a turn per element. renamed: roles are put into common names."""

    name: str
    needed: tuple[str, ...]
    optional: tuple[str, ...]
    turns: tuple[tuple, ...]
    renamed: bool = False


MAPPINGS = (
    Mapping("turn", (), ("role", "text"), (("turn", "role", "text"),)),
    Mapping("turn_content", ("role", "content"), (), (("turn", "role", "content"),)),
    Mapping("turn_from", ("from", "value"), (), (("turn", "from", "value"),), True),
    Mapping("messages", ("messages[].role", "messages[].content"), ("system",), (("say", "system", ("system",)), ("each", "messages", "role", "content"))),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), ("system",), (("say", "system", ("system",)), ("each", "conversations", "from", "value")), True),
    Mapping("prompt_completion", ("prompt", "completion"), ("system",), (("say", "system", ("system",)), ("say", "user", ("prompt",)), ("say", "assistant", ("completion",)))),
    Mapping("prompt_response", ("prompt", "response"), ("system",), (("say", "system", ("system",)), ("say", "user", ("prompt",)), ("say", "assistant", ("response",)))),
    Mapping("question_answer", ("question", "answer"), ("context",), (("say", "user", ("context", "question")), ("say", "assistant", ("answer",)))),
    Mapping("instruction", ("instruction", "output"), ("input", "system"), (("say", "system", ("system",)), ("say", "user", ("instruction", "input")), ("say", "assistant", ("output",)))),
    Mapping("nested_data", ("data.prompt", "data.completion"), (), (("say", "user", ("data.prompt",)), ("say", "assistant", ("data.completion",)))),
)


def paths(value, prefix: str = "") -> set[str]:
    """Nested field paths of a JSON value; lists add [] and join the paths of their elements."""
    out: set[str] = set()
    todo, seen = [(value, prefix, None)], 0  # seen: paths so far; a list under which none came is a path itself
    while todo:
        value, at, before = todo.pop()
        if before is not None:
            if seen == before:
                out.add(at)
                seen += 1
        elif isinstance(value, dict):
            todo += [(v, f"{at}.{k}" if at else k, None) for k, v in value.items()]
        elif isinstance(value, list):
            todo.append((None, f"{at}[]", seen))
            todo += [(v, f"{at}[]", None) for v in value]
        elif at:
            out.add(at)
            seen += 1
    return out


def fingerprint(found: set[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def _known(mappings: tuple[Mapping, ...]) -> dict[str, Mapping]:
    out: dict[str, Mapping] = {}
    for m in mappings:
        for n in range(len(m.optional) + 1):
            for more in itertools.combinations(m.optional, n):
                out.setdefault(fingerprint({*m.needed, *more}), m)
    return out


class Mapper:
    def __init__(self, mappings: tuple[Mapping, ...] = MAPPINGS):
        self.mappings, self.known = mappings, _known(mappings)

    def choose(self, record) -> tuple[str, Mapping | None]:
        found = paths(record)
        key = fingerprint(found)
        if key in self.known:
            return key, self.known[key]
        fits = [m for m in self.mappings if m.needed and found >= {*m.needed} or not m.needed and found & {*m.optional}]
        return key, max(fits, key=lambda m: (len(m.needed), len(found & {*m.optional})), default=None)

    def turns(self, record) -> tuple[str, str | None, list[tuple[str, str]]]:
        """(fingerprint, name of the mapping, turns)."""
        try:
            return self._turns(record)
        except RecursionError:  # a role or text that is itself nested too deep to be written as JSON
            return self.choose(record)[0], None, []

    def _turns(self, record) -> tuple[str, str | None, list[tuple[str, str]]]:
        key, m = self.choose(record)
        if m is None or not isinstance(record, dict):
            return key, None, []
        out = []
        for kind, *spec in m.turns:
            if kind == "say":
                texts = [str(x) for p in spec[1] if (x := _at(record, p)) not in (None, "")]
                if texts or spec[0] != "system":
                    out.append((spec[0], "\n\n".join(texts)))
            elif kind == "turn":
                out.append(self.named(m, _at(record, spec[0]), _at(record, spec[1])))
            else:
                out += [self.named(m, x.get(spec[1]), x.get(spec[2])) for x in _at(record, spec[0]) or [] if isinstance(x, dict)]
        return key, m.name, out

    @staticmethod
    def named(m: Mapping, role, text) -> tuple[str, str]:
        role, text = ("" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in (role, text))
        return (_ROLES.get(role.lower(), role) if m.renamed else role), text


def _at(record, path: str):
    for part in path.split("."):
        record = record.get(part) if isinstance(record, dict) else None
    return record


def _parsed(text: str | None):
    try:
        return json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None


def canonical_turns(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Records (conv_id, turn, record as JSON) as rows conv_id, turn, pos, role, text."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        it, out = Mapper(mappings), []
        for conv, turn, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "record")), strict=True):
            out += [(conv, turn, i, role, said) for i, (role, said) in enumerate(it.turns(_parsed(text))[2])]
        kinds = {"conv_id": pa.int64(), "turn": pa.int64(), "pos": pa.int32(), "role": pa.string(), "text": pa.string()}
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds.values(), strict=True)], names=list(kinds))

    return map_batches(records.select("conv_id", "turn", "record"), f, "conv_id long, turn long, pos int, role string, text string")


def layouts(records: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """How many records have each fingerprint, and its layout (null if none fits): fingerprint, layout, records."""

    def f(batch: pa.RecordBatch) -> pa.RecordBatch:
        it = Mapper(mappings)
        both = [it.turns(_parsed(x))[:2] for x in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_pydict({"fingerprint": [a for a, _ in both], "layout": pa.array([b for _, b in both], pa.string())})

    return map_batches(records.select("record"), f, "fingerprint string, layout string").groupBy("fingerprint", "layout").agg(F.count("*").alias("records"))


def escape(text: Column) -> Column:
    for c in ("\\", "<", "["):
        text = F.replace(text, F.lit(c), F.lit(c + "\\"))
    return text


def unescape(text: str) -> str:
    """Takes escape() back: drops the backslash after each special character; backslash n is a line end."""
    return re.sub(r"([<\[\\])\\|\\n", lambda m: m[1] or "\n", text)


def format_turns(turns: DataFrame) -> DataFrame:
    """One row per turn: conv_id, turn, pos, formatted, mask_start, mask_chars (code points of `formatted` under loss)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(OPEN), F.replace(escape(role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    body = escape(text)
    chars = F.when(role == LOSS_ROLE, F.char_length(body)).otherwise(0)
    return turns.select("conv_id", "turn", "pos", F.concat(head, body, F.lit(CLOSE)).alias("formatted"), F.when(chars > 0, F.char_length(head)).otherwise(0).alias("mask_start"), chars.alias("mask_chars"))


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn in formatted text."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError(f"no turn starts at {formatted[at : at + 40]!r}")
        line = formatted.index("\n", at)
        end = formatted.index(CLOSE, line)
        yield unescape(formatted[at + len(OPEN) : line]), unescape(formatted[line + 1 : end])
        at = end + len(CLOSE)


class _Reader:
    """Running digests of a conversation."""

    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.loss = conv, 0, 0, 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, start: int, chars: int) -> None:
        for role, text in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        said = unescape(formatted[start : start + chars])
        self.loss, self.chars = self.loss + len(said), self.chars + len(formatted)
        self.masked.update(said.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted rows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for batch in batches:
            for conv, text, start, chars in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "mask_start", "mask_chars")), strict=True):
                if now is None or now.conv != conv:
                    out += [now.row()] if now else []
                    now = _Reader(conv)
                now.add(text, start, chars)
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
        if now:
            yield batch_of([*out, now.row()])

    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "pos", "formatted")
    return rows.mapInArrow(f, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def turn_records(conversations: DataFrame) -> DataFrame:
    """Rows by turn as JSON records: conv_id, turn, record."""
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.to_json(F.struct("role", "text")).alias("record"))
