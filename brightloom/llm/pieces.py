"""Exact encoding and decoding with a merge-type SentencePiece vocabulary.

A text is cut into stretches over which no merge can reach. Each stretch is encoded by
backtracking: take the longest piece that starts here, check that it can stand beside the
piece before it (re-merging the two gives the two again), else try the next shorter one;
positions from which no way leads to the end are remembered in a bit field.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
NORMAL, BYTE = 1, 6  # kinds of pieces in the model file


def read_model(path: str) -> tuple[list[tuple[str, float, int]], bool]:
    """(piece, score, kind) by id, and whether a blank is put before a text."""
    from sentencepiece import sentencepiece_model_pb2 as format_of

    model = format_of.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback:
        raise ValueError("a merge-type vocabulary with byte fallback is needed")
    if model.normalizer_spec.name != "identity" or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("a vocabulary without normalisation is needed")
    return [(p.piece, p.score, p.type) for p in model.pieces], model.normalizer_spec.add_dummy_prefix


class Remembered(dict):
    """Packed ids of stretches as they come; when the store is full, the half not used of late is forgotten."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.half, self.older = make, size // 2, {}

    def __missing__(self, part: str) -> bytes:
        known = self.older.get(part)
        if known is None:
            known = self.make(part)
            if len(part) > 64:  # longer ones hardly come back
                return known
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[part] = known
        return known


class Codec:
    """Encoder and decoder of one vocabulary. remembered: stretches and pairs kept at once."""

    def __init__(self, path: str, remembered: int = 800_000):
        pieces, self.prefixed = read_model(path)
        self.remembered = remembered
        self.ids = {piece: i for i, (piece, _, kind) in enumerate(pieces) if kind == NORMAL}
        self.scores = {piece: score for piece, score, kind in pieces if kind == NORMAL}
        self.byte_ids = {int(piece[3:5], 16): i for i, (piece, _, kind) in enumerate(pieces) if kind == BYTE}
        values = {i: byte for byte, i in self.byte_ids.items()}
        self.surface = [
            bytes([values[i]]) if i in values else piece.replace(SPACE, " ").encode() if kind == NORMAL else b"" for i, (piece, _, kind) in enumerate(pieces)
        ]
        self.raw_bytes = frozenset(values)
        self.alone = all(c in self.ids for c in set(chain.from_iterable(self.ids)))
        self.known = frozenset(chain.from_iterable(self.ids))
        # Only pieces that merging their characters gives can be part of an encoding.
        self.standing = {piece: i for piece, i in self.ids.items() if self.merged(piece) == [piece]}
        self.matcher = ahocorasick.Automaton()
        for piece, i in self.standing.items():
            self.matcher.add_word(piece, (len(piece), i))
        self.matcher.make_automaton()
        self.text_of = [piece for piece, _, _ in pieces]
        self.spines: dict[tuple[str, bool], list[tuple[str, float, float]] | None] = {}
        self.beside: dict[int, bool] = {}
        self.stretches = Remembered(self._stretch, remembered // 2)
        self.words = Remembered(lambda word: self._marked(SPACE + word), remembered)
        self.cut = self._cuts()

    def _cuts(self) -> re.Pattern:
        """Stretches that no merge can join: no piece has the two characters beside each other where one ends.

        That holds before a blank, around characters no piece has, and after a letter before an
        `ending`: an ASCII mark that pieces have only after blanks and what isn't a letter.
        """
        pairs = {pair for piece in self.ids for pair in zip(piece, piece[1:])}
        ascii_ = [c for c in map(chr, range(128)) if not c.isalnum()]
        barred = re.escape("".join(c for c in ascii_ if c not in self.known))
        self.by_words = self.prefixed and not any(y == SPACE != x for x, y in pairs)
        if any(y == SPACE != x for x, y in pairs):  # a piece may reach over a blank
            return re.compile(f"[^{barred}]+|[{barred}]")
        marks = sorted(c for c in self.known if not c.isalpha())
        endings = [y for y in ascii_ if y in self.known and not any(x.isalpha() for x, z in pairs if z == y)]
        mark, ending = re.escape("".join(marks)), re.escape("".join(endings))
        rest = f"[^{SPACE}{barred}]*"
        word = f"{SPACE}*[^{SPACE}{ending}{barred}]+(?:(?<=[{mark}])[{ending}]{rest})?"
        return re.compile(f"{word}|{SPACE}*[{ending}]{rest}|{SPACE}+|[{barred}]")

    def merged(self, symbols: Iterable[str]) -> list[str]:
        """Merge best-scored neighbours, the leftmost first, until no piece can be made."""
        parts = list(symbols)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, piece: str, right: bool) -> list[tuple[str, float, float]] | None:
        """Parts on one edge of a piece as it is merged, each with the scores of the merge that makes it
        and of the one that takes it up; none if the merges of the piece don't fall in score."""
        key = piece, right
        if key not in self.spines:
            parts, made = list(piece), [float("inf")] * len(piece)
            edge, found, last, falls = -right, [], float("inf"), True
            while len(parts) > 1:
                at = max(range(len(parts) - 1), key=lambda i: (self.scores.get(parts[i] + parts[i + 1], float("-inf")), -i))
                score = self.scores[parts[at] + parts[at + 1]]
                falls, last = falls and score < last, score
                if (at == len(parts) - 2) if right else (at == 0):
                    found.append((parts[edge], made[edge], score))
                parts[at : at + 2], made[at : at + 2] = [parts[at] + parts[at + 1]], [score]
            self.spines[key] = [*found, (piece, made[0], float("-inf"))] if falls else None
        return self.spines[key]

    def fits(self, pair: int) -> bool:
        """Whether re-merging two neighbours, the id of the left one in the upper 32 bits, gives the two again.

        It doesn't if some part at the end of the left one and some part at the start of the right
        one are there at once and have a better score together than with their own side.
        """
        if len(self.beside) >= self.remembered:
            self.beside.clear()
        left, right = self.text_of[pair >> 32], self.text_of[pair & 0xFFFFFFFF]
        ends, starts = self.spine(left, True), self.spine(right, False)
        if ends is None or starts is None:
            known = self.merged(left + right) == [left, right]
        else:
            known = True
            for part, made, taken in ends:
                for other, its_made, its_taken in starts:
                    score = self.scores.get(part + other)
                    if score is not None and (when := min(score, made, its_made)) > taken and when >= its_taken and min(made, its_made) > its_taken:
                        known = False
        self.beside[pair] = known
        return known

    def _pieces(self, text: str) -> list[int]:
        """Ids of the pieces of a text of known characters."""
        whole = self.standing.get(text)
        if whole is not None:
            return [whole]
        choices: list[list[tuple[int, int]]] = [[] for _ in text]
        for last, piece in self.matcher.iter(text):
            choices[last + 1 - piece[0]].append(piece)  # the shortest first
        known, fits = self.beside.get, self.fits
        found: list[int] = []
        sizes: list[int] = []
        dead, at, end = bytearray(len(text) // 8 + 1), 0, len(text)
        before = -1
        while at < end:
            options = choices[at]
            while options:
                size, piece = options.pop()
                there = at + size
                if dead[there >> 3] >> (there & 7) & 1:
                    continue
                if before >= 0:
                    pair = before << 32 | piece
                    fit = known(pair)
                    if not (fits(pair) if fit is None else fit):
                        continue
                found.append(piece)
                sizes.append(size)
                before, at = piece, there
                break
            else:
                if not found:
                    raise ValueError("this vocabulary has no encoding of the text")
                dead[at >> 3] |= 1 << (at & 7)
                at -= sizes.pop()
                found.pop()
                before = found[-1] if found else -1
        return found

    def _stretch(self, text: str) -> bytes:
        if self.known.issuperset(text) and self.alone:
            return array("i", self._pieces(text)).tobytes()
        ids: list[int] = []
        run: list[str] = []

        def close() -> None:
            if run:
                ids.extend(self._pieces("".join(run)))
                run.clear()

        for char in text:
            if char in self.known:
                run.append(char)
            else:
                close()
                ids.extend(self.byte_ids[b] for b in char.encode())
        close()
        return array("i", ids).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Ids (int32) of a whole text."""
        if not text:
            return np.zeros(0, np.int32)
        if not self.by_words or "  " in text or SPACE in text or text[0] == " " or text[-1] == " ":
            packed = self._marked((SPACE if self.prefixed else "") + text.replace(" ", SPACE))
        else:
            packed = b"".join(map(self.words.__getitem__, text.split(" ")))
        return np.frombuffer(packed, np.int32)

    def _marked(self, text: str) -> bytes:
        """Packed ids of a text whose blanks are marked."""
        return b"".join(map(self.stretches.__getitem__, self.cut.findall(text)))

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; a byte that belongs to no character becomes U+FFFD."""
        data = b"".join(map(self.surface.__getitem__, ids))
        if self.prefixed and ids and ids[0] not in self.raw_bytes and data[:1] == b" ":
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            text = []
            while data:
                try:
                    text.append(data.decode())
                    break
                except UnicodeDecodeError as error:
                    text.append(data[: error.start].decode() + "�")
                    data = data[error.start + 1 :]
            return "".join(text)


_codecs: dict[str, Codec] = {}


def codec_of(path: str) -> Codec:
    """The vocabulary, loaded once in each Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _on_worker(model: str) -> str:
    return SparkFiles.get(model[6:]) if model.startswith("added:") else model


def _lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    return pa.ListArray.from_arrays(ends, np.concatenate([*found, np.zeros(0, np.int32)]))


def encode_pieces(docs: DataFrame, model: str, decoded: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text, with `decoded` also the text made from the ids; no shuffle.

    model: path of the vocabulary on every machine, or `added:NAME` for one handed out with
    `SparkContext.addFile`. A null text counts as empty and has no ids; null ids and repeated
    rows pass through; other columns are not looked at; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(_on_worker(model))
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                found = [codec.encode(text.as_py() or "") for text in batch.column(1)]
                columns = {"doc_id": batch.column(0).cast(pa.int64()), "ids": _lists(found)}
                if decoded:
                    columns["decoded"] = pa.array([codec.decode(ids.tolist()) for ids in found], pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(id_column, text_column).mapInArrow(run, "doc_id bigint, ids array<int>" + ", decoded string" * decoded)


def decode_pieces(encoded: DataFrame, model: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, the ids and the text they stand for; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(_on_worker(model))
        for batch in batches:
            text = pa.array([codec.decode(ids.as_py() or []) for ids in batch.column("ids")], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "decoded"])

    kept = encoded.select(*keep, "ids")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", decoded string"
    return kept.mapInArrow(run, schema)


def piece_digests(decoded: DataFrame) -> DataFrame:
    """Number of ids, and digests of the ids and of the decoded text."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
