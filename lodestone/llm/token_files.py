"""Token-id files: documents encoded with a public tokenizer and written as ORC.

A row of a file is a document: doc_id, its ids with an end id after them, how many they are, and how many ids come before it in its part. ORC packs the ids by its integer run-length encoding, keeps a row index with the least and greatest doc_id of each stride in every stripe, and a Bloom filter on doc_id. A reader can take stripes in parallel, and looking up documents skips files, stripes and strides by this metadata. Files hold ascending doc_ids, each file a range of its own.

A null text counts as empty: it has the end id alone. Null doc_ids come first. Rows with equal doc_ids follow each other in the order of their texts' hashes, and `start` counts in the order in which rows stand in the files. Columns other than id and text aren't read, whatever their names. An empty table gives no rows.

Encoding goes by parts: a text is cut before spaces, where the byte-level splitter of the tokenizer cuts too, and parts that a worker hasn't met are split and encoded by the tokenizer's model, many at once. A text in which that could differ (a space between white space, the string of a special token) is encoded whole, and so is a part in scripts on which Unicode versions may differ.
"""

from __future__ import annotations

import re
import string
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import delete_at_exit, documents, new_path, release, releasing

END_ID = 0
#: Parts, and pieces, that a worker remembers.
PARTS, PIECES = 200_000, 300_000
#: Pieces that the model encodes in one call.
AT_ONCE = 512
#: Bytes of text that are encoded at once.
RUN_BYTES = 1 << 20
STRIPE_BYTES, STRIDE_ROWS = 64 << 20, 1000
_workers: dict = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Texts to ids, kept as little-endian 32-bit bytes. Equal to the tokenizer's encoding of the whole texts.

    `parts` holds what follows a space, `pieces` what the byte-level splitter makes of a part; each is encoded once while there is room.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.separator = self._separator()
        self.parts: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _separator(self) -> int | None:
        """The id of the letter that stands for byte 255, which UTF-8 never has, if no longer token holds it: the model merges nothing with it."""
        holding = [i for token, i in self.tokenizer.get_vocab().items() if BYTE_LETTERS[255] in map(ord, token)]
        return holding[0] if len(holding) == 1 and self.tokenizer.id_to_token(holding[0]) == chr(BYTE_LETTERS[255]) else None

    def _model(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces of PLAIN texts by the tokenizer's model, which takes many with a separator after each; one by one where there is no such."""
        if self.separator is None:
            return [array("I", [t.id for t in self.model.tokenize(_letters(p))]).tobytes() for p in pieces]
        found = []
        for at in range(0, len(pieces), AT_ONCE):
            ids = np.array([t.id for t in self.model.tokenize(_letters("\0".join([*pieces[at : at + AT_ONCE], ""])))], "<u4")
            ends = 4 * np.flatnonzero(ids == self.separator)
            every = ids.tobytes()
            found += [every[a:b] for a, b in zip([0, *(ends[:-1] + 4).tolist()], ends.tolist(), strict=True)]
        return found

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self._model([piece])[0]
            if len(self.pieces) < PIECES:
                self.pieces[piece] = ids
        return ids

    def plain_parts(self, parts: list[str]) -> list[bytes]:
        """Ids of parts with a space before each. PLAIN matches them, and none is empty or begins with white space, so the splitter makes of all together what it makes of each, and a piece with a space begins a part."""
        pieces = SPLIT_PLAIN.findall(" " + " ".join(parts))
        new = [p for p in dict.fromkeys(pieces) if p not in self.pieces]
        made = dict(zip(new, self._model(new), strict=True))
        self.pieces.update(islice(made.items(), max(0, PIECES - len(self.pieces))))
        found: list[bytes] = []
        for piece in pieces:
            ids = made[piece] if piece in made else self.pieces[piece]
            if piece[0] == " ":
                found.append(ids)
            else:
                found[-1] += ids
        return found

    def part(self, text: str, plain: bool, space: str = "") -> bytes:
        """plain: PLAIN matches it. Letters are one piece, and marks after them another; what else there is goes to the splitter."""
        if plain:
            word = text.rstrip(MARKS)
            if word.isalpha():
                return self.piece(space + word) + self.piece(text[len(word) :]) if len(word) < len(text) else self.piece(space + word)
            return b"".join([self.piece(p) for p in SPLIT_PLAIN.findall(space + text)])
        if PLAIN.fullmatch(text):
            return self.part(text, True, space)
        return self.whole(space + text)

    def cut(self, text: str) -> bool:
        """Whether pieces end before every space of the text, so that parts can be encoded by themselves."""
        if self.special is not None and "<|" in text and self.special.search(text):
            return False
        if " \n" in text or "\n " in text or "  " in text or text[-1:] == " " or _other_space(text):
            return ODD_SPACE.search(text) is None
        return True

    def __call__(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another, each with the end id after it, and how many each has. Every different part of the texts is looked up once."""
        end, heads, cut = np.array([end_id], "<u4").tobytes(), [], []
        for text in texts.to_pylist():
            cut.append(own := self.cut(text or ""))
            # what begins a text has no space before it; a text that isn't cut is all beginning
            heads.append(self.part((text or "").partition(" ")[0], False) if own else self.whole(text))
        lists = pc.split_pattern(pc.if_else(pa.array(cut), pc.fill_null(texts, ""), ""), " ")
        coded = lists.flatten().dictionary_encode()
        # no part has a space, so all come over as one text
        every = pc.binary_join(pa.ListArray.from_arrays([0, len(coded.dictionary)], coded.dictionary), " ")[0].as_py()
        parts, known, plain = every.split(" "), self.parts, PLAIN.fullmatch(every) is not None
        found = list(map(known.get, parts))
        new = [i for i, ids in enumerate(found) if ids is None]
        together = [i for i in new if parts[i] and not parts[i][0].isspace() and (plain or PLAIN.fullmatch(parts[i]))]
        for i, ids in zip(together, self.plain_parts([parts[i] for i in together]) if together else [], strict=True):
            found[i] = ids
        for i in new:
            if found[i] is None:
                found[i] = self.part(parts[i], plain, " ")
        known.update((parts[i], found[i]) for i in new[: max(0, PARTS - len(known))])
        # the end id of a text stands before the beginning of the next
        table = [*found, heads[0], *(end + h for h in heads[1:])]
        size = np.fromiter(map(len, table), np.int64, len(table)) // 4
        start = np.cumsum(size) - size
        units = coded.indices.to_numpy().copy()
        first = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        units[first] = len(found) + np.arange(len(first))
        n = size[units]
        to = np.cumsum(n)
        ids = np.empty(to[-1] + 1, "<u4")
        at = np.repeat(start[units] - to + n, n)
        at += np.arange(to[-1])
        np.take(np.frombuffer(b"".join(table), "<u4"), at, out=ids[:-1])
        ids[-1] = end_id
        # all but the first have counted the end id before them in place of their own
        lengths = np.add.reduceat(n, first)
        lengths[0] += 1
        return ids, lengths


#: Texts of scripts on which Unicode versions agree.
PLAIN = re.compile(r"[\x09\x0A\x0D\x20-\x7E\xA1-\u024F]*")


def _split_plain() -> re.Pattern:
    """The splitter of the byte-level tokenizer, with its classes written out for the characters of PLAIN."""
    plain = "".join(c for c in map(chr, range(0x250)) if PLAIN.fullmatch(c))
    letters, numbers, marks = ("".join(map(re.escape, regex.findall(c, plain))) for c in (r"\p{L}", r"\p{N}", r"[^\s\p{L}\p{N}]"))
    return re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[{marks}]+|\s+(?!\S)|\s+")


SPLIT_PLAIN = _split_plain()
#: A space between white space, or at the end after some: cutting there changes pieces; before any other space the splitter cuts itself.
ODD_SPACE = re.compile(r"\s (?:\s|\Z)")
OTHER_SPACE = re.compile(r"[^\S \n]")
#: Those among the first 256 characters.
NARROW_SPACES = tuple(c for c in map(chr, range(256)) if OTHER_SPACE.match(c))


def _other_space(text: str) -> bool:
    try:
        text.isascii() or text.encode("latin-1")
    except UnicodeEncodeError:
        return OTHER_SPACE.search(text) is not None
    # ten searches for a character take less than one for a class
    return any(c in text for c in NARROW_SPACES)


#: Marks of ASCII, which the splitter leaves together where no letter or number follows them.
MARKS = string.punctuation


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in the vocabulary: printable ones for themselves, the others from 256 on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()
#: The same as code points by byte; byte 0, which PLAIN hasn't, gives the letter of the separator.
LETTERS = np.array([BYTE_LETTERS[b or 255] for b in range(256)], "<u4")


def _letters(text: str) -> str:
    return LETTERS[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")


def _encode(path: str, end_id: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _workers:
            _workers[path] = PieceEncoder(path)
        encoder, before = _workers[path], 0
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
            at = 0
            while at < len(sizes):
                # so many bytes of text at once; a longer document by itself
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + RUN_BYTES, "right")))
                flat, lengths = encoder(batch.column(1).slice(at, to - at), end_id)
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                ids = pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(before + offsets[:-1], pa.int64()), pa.array(lengths), lists], ["doc_id", "part_start", "n_ids", "ids"])
                before, at = before + len(flat), to

    return encode


FILES = "doc_id long, part_start long, n_ids long, ids array<int>"


def write_token_files(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Writes df's documents to ORC files in path, in ascending order of the key (a long). Parts are ranges of key and text hash, so rows that repeat a key may be dealt over several."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_h"))
    rows = rows.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")
    encoded = rows.mapInArrow(releasing(_encode(tokenizer or tokenizer_path(), end_id)), FILES)
    options = {
        "orc.compress": "ZSTD",
        "orc.stripe.size": str(STRIPE_BYTES),
        "orc.row.index.stride": str(STRIDE_ROWS),
        "orc.create.index": "true",
        "orc.bloom.filter.columns": "doc_id",
        "orc.bloom.filter.fpp": "0.01",
    }
    encoded.write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids of token files. Filters on doc_id prune files, stripes and strides."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    # files are whole before they are read, so a worker that encoded them needs its encoder no more
    _workers.clear()
    release()
    for batch in batches:
        lists = batch.column("ids")
        offsets, data = lists.offsets.to_numpy(), memoryview(lists.values.to_numpy().astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        kept = [batch.column(c) for c in ("part", "file", "doc_id", "part_start")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], ["part", "file", "doc_id", "part_start", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and its file, all read from the files. A row's place in its part stands beside it; what the parts before hold is summed from two small columns, one row for each part, so no task holds more and no document is shuffled."""
    name = F.col("_metadata.file_name")
    rows = spark.read.schema(FILES).orc(path).select("*", name.alias("file"), F.regexp_extract(name, r"part-(\d+)", 1).cast("long").alias("part"))
    sums = rows.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_ids")).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # a row for each part: as many as the tasks that wrote
    sums = F.broadcast(sums.select(F.col("part").alias("_part"), before.alias("_before")))
    made = rows.select("part", "file", "doc_id", "part_start", "ids").mapInArrow(releasing(_digest), "part long, file string, doc_id long, part_start long, n_tokens long, ids_crc32 long")
    return made.join(sums, F.col("part") == F.col("_part")).select("doc_id", (F.col("_before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32", "file")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    delete_at_exit(spark, path)
    write_token_files(documents(spark, sf_dir, "doc_id", "text"), path)
    return token_index(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
