"""Byte-pair encoding of whole texts with a given tokenizer file, and decoding.

White space always ends a token, so a text is encoded word by word and equal words are looked
up. A text with a long run without white space is cut into pieces that are encoded in parallel,
as rows of their own, and joined as a tree: around each join a growing window of the text is
encoded anew until it shows a token of the left side and a token of the right side, each with
the same number and the same place. From there on the sides are as they would be in the whole.
Why this is exact: merges are ranked, so a sequence of tokens is the encoding of its text if
every two neighbours are the encoding of theirs. At a shared token the neighbours on one side
come from one encoding and those on the other side from the other, so all of them are.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

# Runs without white space beyond this many characters are cut.
PIECE = 8192

# Entries of the table of words that a task keeps; it starts anew when full.
KNOWN_WORDS = 500_000


def load(path: str):
    """The tokenizer as it is in its file, without truncation and padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


# The settings of a tokenizer file under which a plain word is one run of letters,
# in lower case and spelt byte by byte, and one run of stops.
_NORMALIZERS = ["NFC", "Replace", "Lowercase"]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

# Latin letters that are single characters in every normal form used, then stops.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([.,;:!?#$%&*()+/=-]*)")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if printable, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


class WordTable:
    """Token numbers of texts, each distinct word encoded once as long as the table has room.

    With a tokenizer file of the kind above, plain words go straight to the merges, by runs of
    letters; all other words go through the whole tokenizer.
    """

    def __init__(self, tokenizer, room: int = KNOWN_WORDS):
        self.tokenizer, self.room = tokenizer, room
        self.known: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.letters = _byte_letters()
        spec = json.loads(tokenizer.to_str())
        steps = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        patterns = [x["pattern"].get("Regex") for x in splits if x["type"] == "Split"]
        self.direct = steps == _NORMALIZERS and patterns == [_SPLIT] and [x["type"] for x in splits] == ["Split", "ByteLevel"] and spec["model"]["type"] == "BPE"

    def run(self, letters: str) -> bytes:
        found = self.runs.get(letters)
        if found is None:
            spelt = letters.encode().decode("latin-1").translate(self.letters)
            found = array("I", [t.id for t in self.tokenizer.model.tokenize(spelt)]).tobytes()
            if len(self.runs) >= self.room:
                self.runs = {}
            self.runs[letters] = found
        return found

    def learn(self, words: list[bytes]) -> None:
        known, other = self.known, []
        for word in words:
            plain = _PLAIN.fullmatch(word.decode()) if self.direct else None
            if plain is None:
                other.append(word)
            else:
                known[word] = self.run(plain[1].lower()) + (self.run(plain[2]) if plain[2] else b"")
        for word, got in zip(other, self.tokenizer.encode_batch_fast([w.decode() for w in other], add_special_tokens=False)):
            known[word] = array("I", got.ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        words = text.encode().split()
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > self.room:
            self.known, new = {}, set(words)
        if new:
            self.learn(list(new))
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype="<u4")


@dataclass
class Encoded:
    """Tokens of text[start:end]; `places` holds each token's (start, end) in the whole text."""

    start: int
    end: int
    ids: np.ndarray
    places: np.ndarray


def encode_range(tokenizer, text: str, start: int, end: int) -> Encoded:
    got = tokenizer.encode(text[start:end], add_special_tokens=False)
    places = np.array(got.offsets, dtype=np.int64).reshape(-1, 2) + start
    return Encoded(start, end, np.array(got.ids, dtype="<u4"), places)


def join(tokenizer, text: str, left: Encoded, right: Encoded, window: int = 64) -> Encoded:
    """The encoding of both ranges as one, from their own encodings."""
    cut = left.end
    while True:
        a, b = max(left.start, cut - window), min(right.end, cut + window)
        if a == left.start and b == right.end:
            return encode_range(tokenizer, text, a, b)
        middle = encode_range(tokenizer, text, a, b)
        head = (0, 0) if a == left.start else _shared(left, middle, a + window // 4, cut, False)
        tail = (len(middle.ids), len(right.ids)) if b == right.end else _shared(middle, right, cut, b - window // 4, True)
        if head is not None and tail is not None and head[1] < tail[0]:
            ids = np.concatenate([left.ids[: head[0]], middle.ids[head[1] : tail[0]], right.ids[tail[1] :]])
            places = np.concatenate([left.places[: head[0]], middle.places[head[1] : tail[0]], right.places[tail[1] :]])
            return Encoded(left.start, right.end, ids, places)
        window *= 2


def _shared(x: Encoded, y: Encoded, low: int, high: int, last: bool) -> tuple[int, int] | None:
    """Indices of a token that both have between `low` and `high`; one whose characters are its own.

    A character may be spread over tokens that carry the same place, so a token counts only if
    the tokens beside it are at other places.
    """

    def alone(e: Encoded) -> np.ndarray:
        same = np.zeros(len(e.ids) + 1, dtype=bool)
        same[1:-1] = e.places[1:, 0] < e.places[:-1, 1]
        return ~(same[1:] | same[:-1]) & (e.places[:, 0] >= low) & (e.places[:, 1] <= high)

    i, j = np.flatnonzero(alone(x)), np.flatnonzero(alone(y))
    _, at, to = np.intersect1d(x.places[i, 0], y.places[j, 0], assume_unique=True, return_indices=True)
    i, j = i[at], j[to]
    equal = np.flatnonzero((x.places[i, 1] == y.places[j, 1]) & (x.ids[i] == y.ids[j]))
    if not len(equal):
        return None
    k = equal[-1] if last else equal[0]
    return int(i[k]), int(j[k])


def join_all(tokenizer, text: str, pieces: list[Encoded]) -> Encoded:
    """Neighbouring pieces joined in pairs, then pairs of pairs."""
    while len(pieces) > 1:
        pieces = [join(tokenizer, text, *pieces[k : k + 2]) if k + 1 < len(pieces) else pieces[k] for k in range(0, len(pieces), 2)]
    return pieces[0]


def encode_tree(tokenizer, text: str, piece: int = PIECE) -> np.ndarray:
    """Token numbers of a text cut every `piece` characters and joined; for one text at hand."""
    pieces = [encode_range(tokenizer, text, a, min(len(text), a + piece)) for a in range(0, len(text), piece)]
    return join_all(tokenizer, text, pieces).ids if pieces else np.zeros(0, "<u4")


class Decoder:
    """Text of token numbers; special tokens are kept. Without a decoder in the file, a space joins them."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.tokens = None
        if tokenizer.decoder is None:
            vocabulary = tokenizer.get_vocab(with_added_tokens=True)
            self.tokens = {i: t for t, i in vocabulary.items()}

    def text(self, ids: np.ndarray) -> str:
        if self.tokens is None:
            return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


def _row(decoder: Decoder, ids: np.ndarray, keep_ids: bool) -> dict:
    decoded = decoder.text(ids)
    row = {
        "n_tokens": len(ids),
        "ids_sha256": hashlib.sha256(ids.tobytes()).hexdigest(),
        "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest(),
    }
    return row | {"ids": ids.astype(np.int32)} if keep_ids else row


_TYPES = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string(), "ids": pa.list_(pa.int32())}
_SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode(docs: DataFrame, path: str, columns: tuple[str, ...] = ("doc_id",), keep_ids: bool = False, piece: int = PIECE) -> DataFrame:
    """`columns`, n_tokens, digests of the token numbers and of the decoded text, and `ids` on request.

    One row per row of `docs`, repeated rows included. A null or empty text has no tokens and
    decodes to the empty text. Only texts with a run of over `piece` characters without white
    space are shuffled; they are gathered by row, piece by piece.
    """
    schema = f"{_SCHEMA}, ids array<int>" if keep_ids else _SCHEMA
    names = [n for n in _TYPES if keep_ids or n != "ids"]
    whole = docs.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_whole"))
    # The run starts at the text's start or after white space, so that it is tried once a word.
    unsplit = F.col("_whole").rlike(r"(?:^|[\x20\x09-\x0D])[^\x20\x09-\x0D]{" + str(piece) + "}")
    kept = docs.select(*columns).schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def table(rows: list[dict], carried: list[pa.Array]) -> pa.RecordBatch:
        found = [pa.array([r[n] for r in rows], _TYPES[n]) for n in names]
        return pa.RecordBatch.from_arrays([*carried, *found], names=[*kept.names, *names])

    def split_by_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from terrane.llm.text import slices

        words = WordTable(load(path))
        decoder = Decoder(words.tokenizer)
        for batch in slices(batches, "_whole"):
            rows = [_row(decoder, words.encode(t.as_py()), keep_ids) for t in batch.column("_whole")]
            yield table(rows, batch.columns[:-1])

    def encode_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        for batch in batches:
            ids, places = [], []
            for text, at in zip(batch.column("_piece"), batch.column("_at")):
                got = encode_range(tokenizer, text.as_py(), 0, len(text.as_py()))
                ids.append(got.ids.tobytes())
                places.append((got.places + at.as_py()).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary()), pa.array(places, pa.binary())], names=[*batch.schema.names, "_ids", "_places"])

    def gather(group: pa.Table) -> pa.Table:
        tokenizer = load(path)
        group = group.sort_by("_at")
        texts = group.column("_piece").to_pylist()
        pieces = [
            Encoded(a, a + len(t), np.frombuffer(i, "<u4"), np.frombuffer(p, "<i8").reshape(-1, 2))
            for a, t, i, p in zip(group.column("_at").to_pylist(), texts, group.column("_ids").to_pylist(), group.column("_places").to_pylist())
        ]
        got = join_all(tokenizer, "".join(texts), pieces)
        carried = [group.column(c).combine_chunks()[:1] for c in kept.names]
        return pa.Table.from_batches([table([_row(Decoder(tokenizer), got.ids, keep_ids)], carried)])

    plain = whole.where(~unsplit).mapInArrow(split_by_words, f"{ddl}, {schema}")
    cut = whole.where(unsplit).withColumn("_row", F.monotonically_increasing_id())
    cut = cut.withColumn("_at", F.explode(F.expr(f"sequence(0L, length(_whole) - 1L, {piece}L)")))
    cut = cut.withColumn("_piece", F.expr(f"substring(_whole, CAST(_at AS INT) + 1, {piece})")).drop("_whole")
    cut = cut.repartition("_row", "_at")
    encoded = cut.mapInArrow(encode_pieces, StructType([*cut.schema.fields, StructField("_ids", BinaryType()), StructField("_places", BinaryType())]))
    gathered = encoded.groupBy("_row").applyInArrow(gather, f"{ddl}, {schema}")
    return plain.unionByName(gathered)
