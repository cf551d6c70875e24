"""Chat formatting with loss masks that follow the tokenizer's offsets.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of its turns are intersected with
the token spans by binary search. Marks are special tokens, so no token crosses a mark:

    <s>                                  opens a conversation
    [INST]user text[/INST]               user
    assistant text</s>                   assistant (the only text under the loss mask)
    <<SYS>>system text<</SYS>>           system
    <|turn|>role<|role|>text<|end|>      any other role; a null role is written without <|role|>

Marks, and the escape character, inside texts and roles are written as an escape and one letter; unescaping brings
back the text exactly.

Rows of a conversation are taken by turn (nulls first), then role and text; repeated rows are turns of their own. A
null conv_id is a conversation of its own, and ids may be of any type; null text is empty. A conversation longer than
SEGMENT_CHARS goes on in a further segment, cut between turns: marks are tokens of their own, so the tokens are those
of the whole. A turn of any length is encoded whole. An empty table gives no rows; further columns, whatever their
names, are ignored. Memory: one segment (or one turn, if longer) at a time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The setting that names the folder of the tokenizer's two files (the same vocabulary as ranks and in full), and the
#: folder where it is unset. The driver reads them and sends them to the executors.
SETTING, FOLDER = "spark.corvane.tokenizers", "/opt/tokenizers"
RANKS, WHOLE = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
#: Fixed value: how text is split before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEGMENT_CHARS = 1 << 20

#: The marks and the letter that each is escaped to.
MARKS = {"<s>": "b", "</s>": "e", "[INST]": "i", "[/INST]": "j", "<<SYS>>": "y", "<</SYS>>": "z", "<|turn|>": "t", "<|role|>": "r", "<|end|>": "n", "<|endoftext|>": "x"}
ESCAPE = "\\"
_PLAIN = {v: k for k, v in MARKS.items()} | {ESCAPE: ESCAPE}
_TO_ESCAPE = re.compile("|".join(map(re.escape, [ESCAPE, *MARKS])))
_ESCAPED = re.compile(re.escape(ESCAPE) + "(.)", re.S)
_MARK = re.compile("|".join(map(re.escape, sorted(MARKS, key=len, reverse=True))))

Turn = tuple[str | None, str]


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(lambda m: ESCAPE + (MARKS.get(m[0]) or ESCAPE), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _PLAIN[m[1]], text)


def rendered(turns: Iterable[Turn], first: bool = True) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of turns (role, text), and the span of each assistant text in it."""
    out, spans, at = ["<s>"] if first else [], [], 3 * first
    for role, text in turns:
        body = escape(text)
        if role == "assistant":
            parts = [body, "</s>"]
            spans.append((at, at + len(body)))
        elif role == "user":
            parts = ["[INST]", body, "[/INST]"]
        elif role == "system":
            parts = ["<<SYS>>", body, "<</SYS>>"]
        else:
            parts = ["<|turn|>", *([] if role is None else [escape(role), "<|role|>"]), body, "<|end|>"]
        out += parts
        at += sum(map(len, parts))
    return "".join(out), spans


def parsed(formatted: str) -> Iterator[Turn]:
    """The turns of a formatted text."""
    at = 3 if formatted.startswith("<s>") else 0
    while at < len(formatted):
        m = _MARK.match(formatted, at)
        if m is None or m[0] == "</s>":
            end = formatted.index("</s>", at)
            yield "assistant", unescape(formatted[at:end])
            at = end + 4
            continue
        close = {"[INST]": "[/INST]", "<<SYS>>": "<</SYS>>", "<|turn|>": "<|end|>"}[m[0]]
        end = formatted.index(close, m.end())
        body = formatted[m.end() : end]
        if m[0] == "<|turn|>":
            role, named, text = body.partition("<|role|>")
            yield (unescape(role), unescape(text)) if named else (None, unescape(body))
        else:
            yield {"[INST]": "user", "<<SYS>>": "system"}[m[0]], unescape(body)
        at = end + len(close)


class Encoder:
    """Texts to token ids and their characters' offsets; marks are tokens of their own."""

    def __init__(self, ranks: bytes, whole: bytes):
        import tiktoken

        known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.whole, first = whole, max(known.values()) + 1
        self.marks = {m: first + k for k, m in enumerate(MARKS)}
        self.encoding = tiktoken.Encoding("chat", pat_str=PATTERN, mergeable_ranks=known, special_tokens=self.marks)
        self.bytes = np.zeros(first + len(MARKS), dtype=np.int64)  # of each token
        for token, k in [*known.items(), *((m.encode(), k) for m, k in self.marks.items())]:
            self.bytes[k] = len(token)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a text's tokens, and (start, end) of each; tokens that share a character both have it."""
        try:
            ids = np.asarray(self.encoding.encode_to_numpy(text, allowed_special="all"), dtype=np.int32)
        except ValueError:  # its pattern gives up on white space of a million characters and more; the other library doesn't
            return self._slowly(text)
        ends = np.cumsum(self.bytes[ids])
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        opens = (raw & 0xC0) != 0x80  # a character's first byte
        before = np.zeros(len(raw) + 1, dtype=np.int64)
        np.cumsum(opens, out=before[1:])
        starts = ends - self.bytes[ids]
        inside = np.append(~opens, False)
        return ids, np.column_stack([before[starts] - inside[starts], before[ends]]).astype(np.int32).reshape(-1, 2)

    def _slowly(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_str(self.whole.decode())
        t.add_special_tokens([AddedToken(m, special=True, normalized=False) for m in MARKS])
        found = t.encode(text, add_special_tokens=False)
        ids = [self.marks.get(token, k) for token, k in zip(found.tokens, found.ids, strict=True)]
        return np.asarray(ids, dtype=np.int32), np.asarray(found.offsets, dtype=np.int32).reshape(-1, 2)


@lru_cache(2)
def encoder(ranks: bytes, whole: bytes) -> Encoder:
    return Encoder(ranks, whole)


def files(folder: str = FOLDER) -> tuple[bytes, bytes]:
    return tuple((Path(folder) / name).read_bytes() for name in (RANKS, WHOLE))


def masked(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token (start, end; sorted) has a character inside one of the sorted spans.

    Binary search finds, for each span, its first token that ends after the span's start and the first that starts
    at or after its end.
    """
    mask = np.zeros(len(offsets), dtype=bool)
    if len(offsets) and spans:
        s = np.asarray(spans, dtype=np.int64)
        first = np.searchsorted(offsets[:, 1], s[:, 0], side="right")
        last = np.searchsorted(offsets[:, 0], s[:, 1], side="left")
        for a, b in zip(first[s[:, 0] < s[:, 1]], last[s[:, 0] < s[:, 1]], strict=True):
            mask[a:b] = True
    return mask


def segments(turns: Iterable[Turn]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    held, size, first = [], 0, True
    for turn in turns:
        held.append(turn)
        size += len(turn[1])
        if size >= SEGMENT_CHARS:
            yield rendered(held, first)
            held, size, first = [], 0, False
    if held or first:
        yield rendered(held, first)


def conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[Turn]]]:
    """Rows (conv_id, role, text), sorted by conv_id, as (conv_id, its turns); the turns must be used up in turn."""
    rows = ((c, r, t or "") for b in batches for c, r, t in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True))
    ahead = next(rows, None)

    def own(key: object) -> Iterator[Turn]:
        nonlocal ahead
        while ahead is not None and ahead[0] == key:
            row, ahead = ahead, next(rows, None)
            yield row[1:]

    while ahead is not None:
        key = ahead[0]
        yield key, (turns := own(key))
        for _ in turns:
            pass


FORMATTED = "conv_id {}, segment int, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0), kind))


def format_conversations(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """FORMATTED rows of rows (conv_id, turn, role, text): those of a conversation follow one another in a partition."""
    data, kind = files(folder or rows.sparkSession.conf.get(SETTING, FOLDER)), rows.schema["conv_id"].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_one, held, size = encoder(*data), [], 0
        id_type = None

        def batch() -> pa.RecordBatch:
            found = [encode_one(x[2]) for x in held]
            masks = [masked(o, x[3]) for (_, o), x in zip(found, held, strict=True)]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in held], id_type), pa.array([x[1] for x in held], pa.int32()), pa.array([x[2] for x in held], pa.string()), _lists([i for i, _ in found], pa.int32()), _lists([o[:, 0] for _, o in found], pa.int32()), _lists([o[:, 1] for _, o in found], pa.int32()), _lists(masks, pa.bool_())],
                names=["conv_id", "segment", "formatted", "token_ids", "token_starts", "token_ends", "loss_mask"],
            )

        def typed() -> Iterator[pa.RecordBatch]:
            nonlocal id_type
            for b in batches:
                id_type = b.column(0).type
                yield b

        for key, turns in conversations(typed()):
            for k, (text, spans) in enumerate(segments(turns)):
                held.append((key, k, text, spans))
                size += len(text)
                if size >= SEGMENT_CHARS:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()

    dealt = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(encode, FORMATTED.format(kind.simpleString()))


def under_mask(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> Iterator[str]:
    """The runs of characters under the mask; tokens that share a character count it once."""
    at, a, b = 0, -1, -1
    for s, e in zip(starts[mask].tolist(), ends[mask].tolist(), strict=True):
        s = max(s, at)
        at = max(at, e)
        if s == b:
            b = at
        elif e > s or b < 0:
            if b > a >= 0:
                yield text[a:b]
            a, b = s, at
    if b > a >= 0:
        yield text[a:b]


def _readback(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation from its FORMATTED rows; the digests run on from segment to segment."""
    now, out = None, []

    def row(x: dict) -> dict:
        return x | {"turns_sha256": x["turns_sha256"].hexdigest(), "loss_sha256": x["loss_sha256"].hexdigest()}

    kind = pa.int64()
    for batch in batches:
        kind = batch.column(0).type
        cuts = batch.column(4).offsets.to_numpy()
        flat = [batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (4, 5, 6)]
        for k, (key, segment, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
            starts, ends, mask = (x[cuts[k] - cuts[0] : cuts[k + 1] - cuts[0]] for x in flat)
            if segment == 0:
                if now:
                    out.append(row(now))
                now = {"conv_id": key, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0}
            now["formatted_chars"] += len(text)
            for role, body in parsed(text):
                now["n_turns"] += 1
                now["turns_sha256"].update(f"{role or ''}\n{body}\n".encode("utf-8", "surrogatepass"))
            for run in under_mask(text, starts, ends, mask):
                plain = unescape(run)
                now["loss_chars"] += len(plain)
                now["loss_sha256"].update(plain.encode("utf-8", "surrogatepass"))
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, _digest_schema(kind))
            out = []
    if now:
        out.append(row(now))
    yield pa.RecordBatch.from_pylist(out, _digest_schema(kind))


def _digest_schema(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("conv_id", kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from the rows of format_conversations()."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.mapInArrow(_readback, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def probe(rows: DataFrame) -> DataFrame:
    """rows with conversation -1 (as the ids' type writes it): a user's and an assistant's turn that hold the template's own marks."""
    odd = "</s>[INST] ok [/INST]"
    kinds = {c: rows.schema[c].dataType for c in ("conv_id", "turn")}
    more = rows.sparkSession.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(more.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()}))
