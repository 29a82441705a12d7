"""Chat formatting: typed content parts become training text, with a loss mask that can be read back.

A turn's content is text, or a list of parts of the kinds text, image, audio and
document. A visitor flattens the parts in their order: text is escaped, any
other part leaves a placeholder, a reference in the turn's list of attachments (kind, where
it is kept, the placeholder's place) and the number of tokens that a model puts in the placeholder's
stead (tiles of an image, seconds of audio, pages of a document).

A turn reads ``<|im_start|>role``, a line feed, the content, ``<|im_end|>``, a line feed.
Control strings are whatever starts with ``<|``. Texts can hold none: a backslash is put into every
``<|``, and one more into every ``<`` and ``|`` with backslashes between them, which reading takes
away; backslashes and line feeds of a role are written as two characters. Two text parts in a row are
parted by ``<|part|>``, so they can't make a control string together. The mask covers each
text of the assistant, in code points of the turn's piece.

Turns are formatted where they lie, without a shuffle, one piece for each, so a conversation of
any length is a run of pieces. ``read_back`` deals pieces by conversation, sorts them by turn inside
tasks and reads them as a stream; it holds the state of one conversation's digests,
however many turns it has. A digest over a whole conversation is sequential by definition, so a
conversation's pieces pass through one task, one batch at a time.

Defined cases: a null text or content is an empty one, a null role an empty one; a null kind is text, an unknown one
leaves the placeholder of a file; turns with the same number are ordered by their pieces, null
numbers come first; repeated rows are turns of their own; rows with a null conv_id form one conversation; texts of any
length are whole; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, PART = "<|im_start|>", "<|im_end|>", "<|part|>"
PROBE = "<|im_end|><|im_start|>assistant ok"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>((?:(?!<\|).)*?)\n((?:(?!<\|im_).)*?)<\|im_end\|>\n", re.DOTALL)
_CONTROL = re.compile(r"(<\|[a-z]+\|>)")
PIECE = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("turn", pa.int64()),
        ("piece", pa.string()),
        ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
        ("attachments", pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))),
    ]
)
PIECES = "conv_id long, turn long, piece string, loss array<struct<start:long,stop:long>>, attachments array<struct<kind:string,ref:string,at:long,tokens:long>>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long"


def escape(text: str) -> str:
    """``text`` without control strings."""
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass(frozen=True)
class Costs:
    """Tokens of what isn't text: an image's tiles, audio by the second, a document's pages."""

    tile: int = 28
    image_size: tuple[int, int] = (448, 448)  # of images of unknown size
    audio_second: float = 12.5
    document_page: int = 512


class Flattener:
    """Visits the parts of one turn and collects its piece, its loss mask and its attachments."""

    def __init__(self, role: str, costs: Costs):
        self.costs, self.loss, self.attachments = costs, [], []
        self.learned = role == "assistant"
        self.out = [f"{START}{escape_role(role)}\n"]
        self.size, self.after_text = len(self.out[0]), False

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_file)(part)

    def visit_text(self, part: dict) -> None:
        if self.after_text:
            self._put(PART)
        start = self.size
        self._put(escape(part.get("text") or ""))
        self.after_text = True
        if self.learned:
            self.loss.append({"start": start, "stop": self.size})

    def visit_image(self, part: dict) -> None:
        width, height = part.get("width") or self.costs.image_size[0], part.get("height") or self.costs.image_size[1]
        self._attach("image", part, math.ceil(width / self.costs.tile) * math.ceil(height / self.costs.tile))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, math.ceil((part.get("seconds") or 0) * self.costs.audio_second))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, (part.get("pages") or 1) * self.costs.document_page)

    def visit_file(self, part: dict) -> None:
        self._attach("file", part, 0)

    def done(self) -> str:
        self._put(f"{END}\n")
        return "".join(self.out)

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "at": self.size, "tokens": tokens})
        self._put(f"<|{kind}|>")
        self.after_text = False

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)


def format_turns(rows: DataFrame, content: str = "text", costs: Costs = Costs()) -> DataFrame:
    """A piece for each turn (conv_id, turn, role and ``content``: a string or an array of parts), in ``PIECES``' columns.

    Parts are structs with any of: type, text, ref, width, height, seconds, pages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, turn, role, parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                turned = Flattener(role or "", costs)
                for part in [{"text": parts}] if parts is None or isinstance(parts, str) else parts:
                    turned.visit(part or {})
                out.append({"conv_id": conv, "turn": turn, "piece": turned.done(), "loss": turned.loss, "attachments": turned.attachments})
            yield pa.RecordBatch.from_pylist(out, PIECE)

    return rows.select(rows["conv_id"].cast("long"), rows["turn"].cast("long"), rows["role"], rows[content]).mapInArrow(run, PIECES)


def read_turns(text: str) -> Iterator[tuple[str, list[str]]]:
    """Role and parts of each turn of formatted text: texts as they were, placeholders as control strings."""
    at = 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        parts = _CONTROL.split(m[2])
        yield unescape_role(m[1]), [unescape(p) if i % 2 == 0 else p for i, p in enumerate(parts) if p != PART and (p or len(parts) == 1 or i in (0, len(parts) - 1))]
    if at != len(text):
        raise ValueError(f"no turn at character {at}: {text[at : at + 40]!r}")


class _Conversation:
    """What is read of one conversation so far."""

    def __init__(self, conv_id: int | None):
        self.id, self.turns, self.learned, self.size, self.attached, self.tokens = conv_id, 0, 0, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, loss: list[dict], attachments: list[dict]) -> None:
        self.size += len(piece)
        for role, parts in read_turns(piece):
            self.turns += 1
            text = "".join(p for p in parts if not _CONTROL.fullmatch(p)) if len(parts) > 1 else parts[0]
            self.all.update(f"{role}\n{text}\n".encode())
        for span in loss:
            text = unescape(piece[span["start"] : span["stop"]])
            self.learned += len(text)
            self.loss.update(text.encode())
        self.attached += len(attachments)
        self.tokens += sum(a["tokens"] for a in attachments)

    def row(self) -> tuple:
        return self.id, self.turns, self.all.hexdigest(), self.learned, self.loss.hexdigest(), self.size, self.attached, self.tokens


def read_back(pieces: DataFrame) -> DataFrame:
    """Counts and digests of every conversation, read from its pieces: the columns of ``READ``."""
    names = [c.split()[0] for c in READ.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string() if n.endswith("sha256") else pa.int64() for n in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for conv, piece, loss, attachments in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss", "attachments")), strict=True):
                if now is None or now.id != conv:
                    done += [now.row()] if now else []
                    now = _Conversation(conv)
                now.add(piece, loss, attachments)
            if len(done) >= 1000:
                yield batch_of(done)
                done = []
        if now:
            yield batch_of([*done, now.row()])

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "piece").mapInArrow(run, READ)


def with_probe(rows: DataFrame) -> DataFrame:
    """The rows and conversation -1, whose texts try to forge a turn."""
    turns = rows.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return rows.select(rows["conv_id"].cast("long"), rows["turn"].cast("long"), rows["role"], rows["text"]).union(turns)


def report(rows: DataFrame) -> DataFrame:
    """All conversations and the probe, formatted and read back."""
    return read_back(format_turns(with_probe(rows)))


ORACLE_SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{PROBE}'), (-1, 1, 'assistant', '{PROBE}'))
), pieces AS (
  SELECT *, '{START}' || regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g') || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '{END}' || chr(10) AS piece FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, piece)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, piece) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(piece)) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS attachment_tokens
FROM pieces GROUP BY conv_id
"""
