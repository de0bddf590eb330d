"""Token ids of documents in Parquet files laid out for selective reads.

Documents are dealt by ranges of doc_id (and of the text's hash, where ids are equal) into part files and sorted within them, so file order is id order. A file holds
doc_id, pos (the document's place in the file), n_tokens and the ids as list<int32>. Ids get no dictionary: they are delta-packed (the
format's second version), in row groups and pages of set sizes, with page indexes, so a reader takes metadata without the ids, and a
range of documents without the rest. Where a document starts among all ids follows from one total for each file and a running
sum by pos within it; totals are added up by ranges of files, so nothing grows in one task but a row for many files.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import parts, slices
from .storage import shared_dir
from .worker import kept

END_ID = 1
ROW_GROUP_BYTES, PAGE_BYTES, FILE_TEXT_BYTES = 16 << 20, 256 << 10, 16 << 20
#: A task sorts a file's text in the memory of one core (clusters with larger executors take larger files). Smaller files, of so much text at
#: least, where cores would stand idle else; files whose totals are added up together.
LEAST_TEXT_BYTES, FILES = 16 << 20, 1024
#: ASCII punctuation between a letter and white space: the tokenizer splits before it, whatever the letter belongs to.
_MARKED = r"([A-Za-zÀ-ÖØ-öø-ÿ])([!-/:-@\[-`{-~]+)(\s|$)"
WORDS = 1_500_000
BATCH_CHARS = 6_000_000


def _strings(words: pa.Array) -> list[str]:
    """The same as to_pylist, without a scalar for each."""
    return words.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """The tokenizers library's ids of whole texts, with the ids of words remembered in a bounded table.

    The tokenizer drops white space and no token reaches over it, so a text's ids are those of its words, one after
    the other; ASCII punctuation that ends a word is looked up as a word of its own, and ASCII case doesn't matter. Texts that
    hold a special token's string are encoded whole. Only a batch's distinct words are looked up, by hashes kept in order, and compared:
    a look-up costs the same however many words are known.
    """

    def __init__(self, tokenizer_file: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        # The same model for words in lower case of Latin-1's letters alone, which its normalizer and its split leave as they are.
        self.plain = Tokenizer.from_file(tokenizer_file)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        """The known words, in one Arrow array (no object for each), and their ids, one word after the other."""
        self.words, self.counts, self.flat = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        # Their hashes in order, and the word of each.
        self.hashes, self.word_of = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def _find(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The known words' places; -1 for others."""
        if not len(self.words):
            return np.full(len(words), -1)
        order = np.argsort(hashes)
        at = np.empty(len(words), np.int64)
        at[order] = self.word_of[np.minimum(np.searchsorted(self.hashes, hashes[order]), len(self.hashes) - 1)]
        return np.where(np.asarray(pc.equal(self.words.take(pa.array(at)), words)), at, -1)

    def _each(self, words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _letters(self, words: list[str], tokenizer) -> list[bytes]:
        """Ids of words of letters alone: one call for many, told apart by the tokens that end a word."""
        out: list[bytes] = []
        for k in range(0, len(words), 2000):
            some = words[k : k + 2000]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            edges = [0, *(4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()]
            if len(edges) == len(some) + 1:
                packed = ids.tobytes()
                out += [packed[s:e] for s, e in zip(edges[:-1], edges[1:], strict=True)]
            else:  # a letter that the tokenizer splits at
                out += self._each(some)
        return out

    def _learn(self, new: pa.Array, hashes: np.ndarray) -> None:
        """Adds new words; ASCII words by the ids of their lower-case form, other words of Latin-1's letters too."""
        forms = [w.lower() if w.isascii() or w.isalpha() and max(w) <= "\xff" else w for w in _strings(new)]
        plain, letters, others = [], [], []
        for s in set(forms) - {""}:
            (others if not s.isalpha() else plain if s.isascii() or max(s) <= "\xff" else letters).append(s)
        memo = {"": b"", **dict(zip(plain, self._letters(plain, self.plain), strict=True)), **dict(zip(letters, self._letters(letters, self.tokenizer), strict=True)), **dict(zip(others, self._each(others), strict=True))}
        packed = [memo[s] for s in forms]
        order = np.argsort(hashes)
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes, self.word_of = np.insert(self.hashes, at, hashes[order]), np.insert(self.word_of, at, (len(self.words) + order).astype(np.int32))
        self.words = pa.concat_arrays([self.words, new])
        self.counts = np.concatenate((self.counts, np.fromiter(map(len, packed), np.int64, len(packed)) // 4))
        self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(packed), "<u4")))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths): the ids of all texts, one text after the other, as unsigned 32-bit integers."""
        if len(self.words) > WORDS:
            self._forget()
        texts = texts.fill_null("")
        # Split at ASCII white space alone: the library sees any other inside its word.
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, _MARKED, r"\1 \2\3"))
        coded = split.values.dictionary_encode()
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, _strings(coded.dictionary)), np.uint64, len(coded.dictionary))
        at = self._find(coded.dictionary, hashes)
        missing = at < 0
        if missing.any():
            new = coded.dictionary.filter(pa.array(missing))
            at[missing] = np.arange(len(self.words), len(self.words) + len(new))
            self._learn(new, hashes[missing])
        index = at[np.asarray(coded.indices)]
        counts, first = self.counts[index], (np.cumsum(self.counts) - self.counts)[index]
        ends = np.concatenate(([0], np.cumsum(counts)))
        ids = self.flat[np.repeat(first - ends[:-1], counts) + np.arange(ends[-1])]
        bounds = ends[np.asarray(split.offsets)]
        whole = np.flatnonzero(np.asarray(pc.match_substring(texts, "<|")))
        if len(whole):
            parts = np.split(ids, bounds[1:-1])
            for i in whole:
                if any(s in texts[i].as_py() for s in self.special):
                    parts[i] = np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4")
            ids, bounds = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, np.diff(bounds)


def encoder(tokenizer_file: str) -> Encoder:
    return kept(("encoder", tokenizer_file), lambda: Encoder(tokenizer_file))


def write_tokens(docs: DataFrame, tokenizer_file: str, path: str | None = None, end_id: int | None = END_ID, file_text_bytes: int = FILE_TEXT_BYTES, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> str:
    """Writes docs (doc_id, text) as token files under path (default: a new folder in the shared one); gives the path.

    Null and empty texts hold the end id alone (nothing without end_id); long ones are encoded whole. Rows with equal ids follow each other in
    no set order, which pos then fixes; null ids come first. Other columns are not written, whatever their names. An empty table gives files
    without rows.
    """
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_bytes = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(parts(n_bytes, file_text_bytes), min(spark.sparkContext.defaultParallelism, n_bytes // LEAST_TEXT_BYTES))
    # Rows of one id, or of none, may be a third of all: they are dealt out by their texts, and equal rows by their place.
    places = docs.withColumns({"__h": F.xxhash64("text"), "__row": F.monotonically_increasing_id()})
    ranged = places.repartitionByRange(n, "doc_id", "__h", "__row").sortWithinPartitions("doc_id", "__h", "__row").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, done = encoder(tokenizer_file).encode, TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in slices(whole, 1, BATCH_CHARS):
                ids, n = encode(b.column(1))
                if end_id is not None:
                    ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int32)), b.column(0), pa.array(np.arange(done, done + b.num_rows)), pa.array(n), tokens], names=["part", "doc_id", "pos", "n_tokens", "tokens"])
                done += b.num_rows

    (
        ranged.mapInArrow(run, "part int, doc_id long, pos long, n_tokens long, tokens array<int>")
        .write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary#tokens.list.element", "false")
        .option("compression", "zstd")
        .parquet(path)
    )
    return path


def _starts(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows (part, pos, n_tokens and others) of token files with start, the number of ids before each; part and pos go."""
    ahead = (Window.unboundedPreceding, -1)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("range", F.expr(f"part div {FILES}"))
    ranges = sums.groupBy("range").agg(F.sum("n").alias("n")).select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(*ahead)), F.lit(0)).alias("before_range"))  # a row for FILES files
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("range").orderBy("part").rowsBetween(*ahead)), F.lit(0))
    before = sums.select("part", "range", inside.alias("inside")).join(ranges, "range").select("part", (F.col("before_range") + F.col("inside")).alias("before"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("pos").rowsBetween(*ahead)), F.lit(0))
    return rows.withColumn("within", within).join(before, "part").withColumn("start", F.col("before") + F.col("within")).drop("part", "pos", "within", "before")


def starts(files: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, start) of token files: start counts the ids of all documents before, in file order, so rows with equal or null ids
    have their own. Reads no ids. Files without rows give an empty result; further columns are ignored."""
    return _starts(files.select("part", "doc_id", "pos", "n_tokens"), files)


def documents(files: DataFrame, first_id: int, last_id: int) -> DataFrame:
    """(doc_id, pos, n_tokens, tokens) of the documents from first_id to last_id: files, row groups and pages of other ids are not read. Null ids
    are in no range; last_id under first_id gives an empty result."""
    return files.where(F.col("doc_id").between(first_id, last_id)).select("doc_id", "pos", "n_tokens", "tokens")


def read_digests(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of token files, from the ids read back; start as in starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = b.column(4)
            flat = np.asarray(tokens.values).astype("<u4")
            at = np.asarray(tokens.offsets)
            crc = [zlib.crc32(flat[s:e]) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            if not pc.all(pc.equal(pc.list_value_length(tokens), b.column(3))).as_py() and b.num_rows:
                raise ValueError("a token file's counts don't fit its ids")
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(crc, pa.int64())], names=["part", "doc_id", "pos", "n_tokens", "ids_crc32"])

    read = files.select("part", "doc_id", "pos", "n_tokens", "tokens").mapInArrow(run, "part int, doc_id long, pos long, n_tokens long, ids_crc32 long")
    return _starts(read, files).select("doc_id", "start", "n_tokens", "ids_crc32")
