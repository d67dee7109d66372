"""Operator 9: token counts of whole texts, exactly as the tokenizer library gives them.

A text longer than a chunk is encoded by the library in chunks that overlap, with the offsets of
its tokens, and two neighbouring chunks are spliced in their overlap at the first proven stable boundary:
an offset at which both encodings start a word of the pre-tokenizer (with sentencepiece, a piece
after which no piece of the vocabulary can reach back over the space), the text has an ASCII character, both chunk
edges are farther away than any special string is long, and from which on both encodings agree in every
(offset, id) up to that distance from the left chunk's end. Pre-tokenizers match from left to
right without looking back and merges stay within their words, so what stands left of such a
boundary is encoded alike whatever follows, and the other way round; an ASCII character never combines with what is before it. If an
overlap holds no such boundary it is doubled; once it reaches the left chunk's begin, that chunk is
widened, at last up to the text's end.

A text of one chunk needs no splicing. Its ids come from bounded memos that the library fills: of
runs between ASCII white space, and of the words in them where the pre-tokenizer is known. Plain texts are
cut into these words as bytes, many texts at once, and each different word is looked up once. The library with
all its rules (special strings, normalisation, merges) therefore decides every id.

Null texts count as empty. Empty texts have no tokens. Repeated rows are counted once each.
"""

from __future__ import annotations

import os
import re
from collections.abc import Collection, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pointloom.llm.common import arrow_map, leave, slices, texts
from pointloom.session import table

#: Characters of a chunk and of the first overlap, entries of a memo, longest remembered run in bytes.
CHUNK_CHARS, OVERLAP, MEMO, LONGEST = 1 << 14, 256, 250_000, 64
#: Bytes of short texts whose different parts are looked up together.
TOGETHER = 1 << 21
#: Characters that the normaliser keeps or lowers one by one, whatever stands beside them.
_PLAIN = re.compile("[!-&(-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]+")
_PLAIN_TEXT = re.compile("[\t-\r -&(-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u017e]*")
_PART = re.compile("[a-z\u00df-\u00f6\u00f8-\u017e]+|[0-9]|[^\t-\r a-z0-9\u00df-\u00f6\u00f8-\u017e]+")
#: Kinds of the bytes of a lower-case plain text: every byte beyond ASCII belongs to a letter.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[*range(9, 14), 32]], _KIND[[*range(97, 123), *range(128, 256)]], _KIND[48:58] = _SPACE, _LETTER, _DIGIT
_encoders: dict = {}
#: The name under which encoders stay in a worker.
USES = "encoders"


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo(dict):
    """Run of bytes without ASCII white space -> its ids as little-endian 32-bit numbers.

    A run of plain characters (see _PLAIN) is cut where the pre-tokenizer cuts it: letters,
    single digits and other signs. The lower-cased parts have a memo of their own, and the
    library encodes unknown parts by the hundred, set apart by spaces. All other runs (with
    apostrophes, angle brackets or further characters) go to the library whole.
    """

    def __init__(self, model: str) -> None:
        super().__init__()
        self.parts: dict[str, bytes] = {}
        #: Parts that came again after they had become known, since the memo was last full.
        self.again: set[str] = set()
        if model.endswith(".json"):
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(model)
            own.no_truncation()
            own.no_padding()
            self.library = lambda text: own.encode(text, add_special_tokens=False)
            self.encode = lambda text: self.library(text).ids
            self.runs = True
            #: Tokens from chunk edges that splicing keeps away from, more than a special string is long.
            self.margin = 1 + max((len(x.content) for x in own.get_added_tokens_decoder().values()), default=0)
            #: Only this pre-tokenizer is known to cut plain runs as _PART does.
            self.cuts = "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in own.to_str()
        else:
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=model)
            self.library = lambda text: own.encode(text, return_type="proto").pieces
            self.encode = lambda text: own.encode(text)
            self.runs = self.cuts = False  # its pieces hold the white space itself
            self.margin = 1 + max(len(own.id_to_piece(k)) for k in range(own.get_piece_size()))
            #: Whether no piece goes on after a space that follows something else; only then is a space a boundary.
            self.apart = not any("\u2581" in own.id_to_piece(k).lstrip("\u2581") for k in range(own.get_piece_size()))

    def ids(self, run: bytes) -> bytes:
        return np.array(self.encode(run.decode("utf-8", "replace")), "<u4").tobytes()

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, id, whether a word starts) of the library's tokens of a text."""
        out = self.library(text)
        if self.runs:
            ids, starts = np.array(out.ids, "<u4"), np.array([x for x, _ in out.offsets], np.int64)
            words = np.array([-1 if x is None else x for x in out.word_ids], np.int64)
            return starts, ids, np.diff(words, prepend=-2) != 0
        ids, starts = np.array([x.id for x in out], "<u4"), np.array([x.begin for x in out], np.int64)
        space = [self.apart and 0 < x < len(text) and text[x] == " " and text[x - 1].isascii() and not text[x - 1].isspace() for x in starts.tolist()]
        return starts, ids, np.array(space, bool)

    def meet(self, parts: Collection[str]) -> None:
        """Makes all these different parts known; a full memo first forgets those that came once, and what is beyond half of it."""
        if len(self.parts) > MEMO:
            self.parts = {x: self.parts[x] for x in islice(self.again, MEMO // 2)}
            self.again = set()
        unknown = [x for x in parts if x not in self.parts]
        self.again.update(parts)
        if unknown:
            self.again.difference_update(unknown)
            self.learn(sorted(unknown))

    def learn(self, parts: list[str]) -> None:
        """Encodes parts, each of them one word of the pre-tokenizer."""
        for i in range(0, len(parts), 400):
            some = parts[i : i + 400]
            out = self.library(" ".join(some))
            ids, words = np.array(out.ids, "<u4"), np.array(out.word_ids, np.int64)
            cut = np.flatnonzero(np.diff(words)) + 1
            if len(cut) + 1 == len(some):
                edges = [0, *(4 * cut).tolist(), 4 * len(ids)]
                data = ids.tobytes()
                self.parts.update((x, data[edges[k] : edges[k + 1]]) for k, x in enumerate(some))
            else:
                self.parts.update((x, self.ids(x.encode())) for x in some)

    def fill(self, runs: set[bytes]) -> None:
        """Makes all these runs known at once; runs too long to be kept are left to __missing__."""
        new = [x for x in runs if x not in self and len(x) <= LONGEST]
        if not self.cuts or not new:
            return
        if len(self) + len(new) > MEMO:
            self.clear()
        cut = [(x, _PART.findall(text.lower())) for x in new if _PLAIN.fullmatch(text := x.decode("utf-8", "replace"))]
        self.meet({y for _, parts in cut for y in parts})
        get = self.parts.__getitem__
        for x, parts in cut:
            self[x] = b"".join(map(get, parts))

    def __missing__(self, run: bytes) -> bytes:
        out = self.ids(run)
        if len(run) <= LONGEST:
            if len(self) >= MEMO:
                self.clear()
            self[run] = out
        return out


def encoder(model: str) -> Memo:
    """The worker's encoder of a vocabulary file; it stays for later tasks of the same worker, until the worker serves another operator."""
    key = (model, os.getpid())
    if key not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[key] = Memo(model)
        leave(USES, _encoders.clear)
    return _encoders[key]


def boundary(text: str, left: tuple, right: tuple, first: int, begin: int, end: int, margin: int) -> tuple[int, int] | None:
    """Places in left and right tokens of the first proven boundary in text[begin:end]; first: the left token that is proven."""
    last = int(np.searchsorted(left[0], end - margin, side="right"))
    at = np.flatnonzero(left[2][:last] & (left[0][:last] >= begin + margin))
    own = np.flatnonzero(right[2] & (right[0] >= begin + margin) & (right[0] <= end - margin))
    place = dict(zip(right[0][own].tolist(), own.tolist()))
    for i in at[at > first].tolist():
        j = place.get(int(left[0][i]))
        if j is None or not text[left[0][i]].isascii():
            continue
        n = last - i
        if j + n <= len(right[0]) and (left[0][i:last] == right[0][j : j + n]).all() and (left[1][i:last] == right[1][j : j + n]).all():
            return i, j
    return None


def document_ids(text: str, memo: Memo, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP) -> bytes:
    """All ids of one text as little-endian 32-bit numbers, from overlapping chunks (see above)."""

    def spans(begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, ids, fresh = memo.spans(text[begin:end])
        return starts + begin, ids, fresh

    out: list[bytes] = []
    begin, end, first = 0, min(chunk, len(text)), 0
    left = spans(begin, end)
    while end < len(text):
        width, found = overlap, None
        while found is None and end < len(text):
            if width < end - begin:
                at, to = end - width, min(len(text), end - width + max(chunk, 2 * width))
                right = spans(at, to)
                found = boundary(text, left, right, first, at, end, memo.margin)
                width *= 2
            else:
                end, width = min(len(text), end + max(chunk, end - begin)), overlap
                left = spans(begin, end)
        if found is None:
            break
        out.append(left[1][first : found[0]].tobytes())
        left, first, begin, end = right, found[1], at, to
    out.append(left[1][first:].tobytes())
    return b"".join(out)


def short_ids(data: bytes, memo: Memo) -> bytes:
    """All ids of a text of one chunk."""
    return b"".join(map(memo.__getitem__, data.split())) if memo.runs else memo.ids(data)


def batch_ids(column: pa.Array, memo: Memo, chunk: int = CHUNK_CHARS) -> Iterator[tuple[bytes, bytes]]:
    """(UTF-8 bytes, ids) of each row of a string column; texts of more than `chunk` characters are spliced."""
    for at in range(0, len(column), 512):
        yield from _some_ids(texts(column.slice(at, 512)), memo, chunk)


def _some_ids(rows: list[bytes], memo: Memo, chunk: int) -> Iterator[tuple[bytes, bytes]]:
    for i, j in slices([len(x) for x in rows], TOGETHER):
        long: dict[int, str] = {k: text for k in range(i, j) if len(rows[k]) > chunk and len(text := rows[k].decode("utf-8", "replace")) > chunk}
        plain: dict[int, bytes] = {}
        if memo.cuts:
            lower = {k: text.lower().encode() for k in range(i, j) if k not in long and _PLAIN_TEXT.fullmatch(text := rows[k].decode("utf-8", "replace"))}
            plain = dict(zip(lower, plain_ids(list(lower.values()), memo)))
            memo.fill({x for k in range(i, j) if k not in plain and k not in long for x in rows[k].split()})
        for k in range(i, j):
            yield rows[k], document_ids(long[k], memo, chunk) if k in long else plain[k] if k in plain else short_ids(rows[k], memo)


def plain_ids(rows: list[bytes], memo: Memo) -> list[bytes]:
    """All ids of each of some lower-case plain texts, cut as _PART does; each different part is looked up once."""
    if not rows:
        return []
    data, begins = b" ".join([*rows, b""]), np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in rows], out=begins[1:])
    kind = _KIND[np.frombuffer(data, np.uint8)]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    cuts = np.flatnonzero(new).astype(np.int32)
    pieces = pa.Array.from_buffers(pa.string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
    parts, at = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(pieces.indices)
    memo.meet([x for x in parts if not x.isspace()])
    own = [b"" if x.isspace() else memo.parts[x] for x in parts]
    # The ids of the different parts in a row, and for each id of the texts its place there.
    sizes, every = np.array([len(x) // 4 for x in own], np.int64), np.frombuffer(b"".join(own), "<u4")
    n = sizes[at]
    ends = np.cumsum(n)
    place = np.repeat((np.cumsum(sizes) - sizes)[at] - ends + n, n)
    place += np.arange(len(place))
    ids = every[place].tobytes()
    # A text begins after its predecessor's last space, which no id belongs to.
    edge = 4 * np.concatenate([[0], ends])[np.searchsorted(cuts, begins)]
    return [ids[p:q] for p, q in zip(edge[:-1].tolist(), edge[1:].tolist())]


def count_tokens(df: DataFrame, model: str | None = None, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_CHARS) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) for each row; map-only, no shuffle.

    Texts of more than `chunk` characters are encoded in overlapping chunks.
    """
    name = model or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = encoder(name)
        for batch in batches:
            sizes, counts = [], []
            for data, ids in batch_ids(batch.column(1), memo, chunk):
                sizes.append(len(data))
                counts.append(len(ids) // 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df, [id_col, text_col], run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", USES)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
