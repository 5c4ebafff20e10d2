"""Token ids as Parquet list columns that can be read selectively."""

from __future__ import annotations

import json
import os
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from cuespan.llm.chunks import Memo, column_bytes, pair_cuts, ragged, slices, split_chunks
from cuespan.llm.common import materialize, scratch

#: Writer settings: token lists keep a dictionary of 16-bit pages, ids and counts are delta encoded;
#: small row groups and pages, with the page index, let a reader skip to the documents it wants.
FORMAT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
FILE_SCHEMA = "doc_id long, n_tokens int, tokens array<int>"
#: Documents by file, about.
DOCS_PER_FILE = 8192


def _word_breaks() -> np.ndarray:
    """Byte pairs x, y between which the pre-tokeniser always cuts, whatever stands around them.

    Its words are contractions after an apostrophe, ` ?letters`, ` ?digits`, ` ?others`, or runs of
    white space that leave their last letter behind. Only ASCII bytes are judged, and apostrophes
    never, so between letters, digits and others, and before line ends, the cut is certain. Behind
    a line end it is not: white space is cut by what follows it.
    """
    kind = np.zeros(256, np.uint8)
    kind[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
    kind[0x30:0x3A] = 2
    kind[[x for x in range(0x21, 0x7F) if not chr(x).isalnum() and chr(x) != "'"]] = 3
    kind[[0x0A, 0x0D, 0x09]] = 4
    table = (kind[:, None] != kind[None, :]) & (kind[:, None] > 0) & (kind[:, None] < 4) & (kind[None, :] > 0)
    return table.ravel()


WORD_BREAKS = _word_breaks()
#: Bytes before which a space surely starts a word: not white space, nor the first byte of any.
PLAIN = np.ones(256, bool)
PLAIN[:0x21] = False
PLAIN[[0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = False


def word_chunks(data: np.ndarray, offsets: np.ndarray, whole: np.ndarray):
    """Chunks of the rows that are encoded alike alone and in their text; rows marked `whole` are not cut."""
    space = data == 0x20
    space[:-1] &= PLAIN[data[1:]]
    space[-1:] = False
    cut = space | pair_cuts(data, WORD_BREAKS)
    for row in np.flatnonzero(whole):
        cut[offsets[row] : offsets[row + 1]] = False
    return split_chunks(data, offsets, cut)


def with_special(column: pa.Array, special: list[str]) -> np.ndarray:
    """Which texts hold the string of a special token: the library then cuts around it, so they are encoded as a whole."""
    out = np.zeros(len(column), bool)
    for token in special:
        out |= np.asarray(pc.fill_null(pc.match_substring(column, token), False))
    return out


_MEMOS: dict[tuple[int, bool], Memo] = {}


def tokenizer_memo(spec: str, special_as_text: bool) -> Memo:
    """The worker's memo of the tokenizer, kept from task to task."""
    if (key := (zlib.crc32(spec.encode()), special_as_text)) not in _MEMOS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(spec)
        tokenizer.encode_special_tokens = special_as_text
        special = [x.content.encode() for x in tokenizer.get_added_tokens_decoder().values()]

        width = np.zeros(tokenizer.get_vocab_size(), np.int64)
        for token, i in tokenizer.get_vocab().items():
            width[i] = len(token)  # one letter of a token stands for one byte

        def encode(chunks: list[bytes]):
            # Chunks that start with a space start a word wherever they stand, so they go in by the thousand.
            apart = np.fromiter((c[:1] != b" " or any(x in c for x in special) for c in chunks), bool, len(chunks))
            order = np.concatenate([np.flatnonzero(apart), np.flatnonzero(~apart)])
            single = int(apart.sum())
            texts = [chunks[i].decode() for i in order[:single]]
            texts += [b"".join([chunks[i] for i in order[k : k + 1000]]).decode() for k in range(single, len(order), 1000)]
            found = [np.array(x.ids, np.int32) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            flat = np.concatenate(found)
            ends = np.cumsum(np.fromiter((len(chunks[i]) for i in order), np.int64, len(order)))
            bounds = np.concatenate([[0], np.searchsorted(np.cumsum(width[flat]), ends) + 1])
            starts, counts = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
            starts[order], counts[order] = bounds[:-1], np.diff(bounds)
            return flat[ragged(starts, counts)], counts

        _MEMOS.clear()
        _MEMOS[key] = Memo(encode)
    return _MEMOS[key]


def encode_tokens(docs: DataFrame, tokenizer_path: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """(doc_id, n_tokens, tokens) of whole texts; null is empty; `end_id` closes each document.

    A special token's string in a text gives its id, as the library does by default, or with
    special_as_text the ids of its letters.
    """
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))

    def encode(batches):
        memo = tokenizer_memo(spec.value, special_as_text)
        special = [] if special_as_text else [x["content"] for x in json.loads(spec.value)["added_tokens"]]
        for batch in batches:
            for part in slices(batch, "text"):
                whole = with_special(part.column("text"), special)
                ids, bounds = memo.rows(*word_chunks(*column_bytes(part.column("text")), whole))
                if end_id is not None:
                    ids = np.insert(ids, bounds[1:], end_id)
                    bounds = bounds + np.arange(len(bounds))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds).astype(np.int32)), lists], ["doc_id", "n_tokens", "tokens"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, FILE_SCHEMA)


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int | None = None, files: int | None = None, **columns) -> str:
    """Writes the documents' token ids as Parquet below `path`, in ascending doc_id order over all files.

    Documents are dealt to files by ranges of doc_id before they are encoded. Null ids come
    first; rows that repeat an id are stored next to each other, in the order of their texts.
    """
    files = files or max(1, -(-docs.count() // DOCS_PER_FILE))
    text = columns.get("text_col", "text")
    name = columns.get("id_col", "doc_id")
    rows = docs.select(F.col(name).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    encode_tokens(rows, tokenizer_path, end_id).write.options(**FORMAT).parquet(path)
    return path


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, with_tokens: bool = True) -> DataFrame:
    """doc_id, n_tokens and, unless left out, tokens of the documents first..last: only their pages are read."""
    out = spark.read.schema(FILE_SCHEMA).parquet(path)
    if first is not None:
        out = out.where(F.col("doc_id") >= first)
    if last is not None:
        out = out.where(F.col("doc_id") <= last)
    return out if with_tokens else out.drop("tokens")


def with_starts(rows: DataFrame) -> DataFrame:
    """Adds `start`, the ids before each document, to rows with n_tokens, _file and _row.

    Files hold ranges of doc_id in ascending order, so counts are summed by file, the few file
    sums are added up in order, and documents are only summed within their file.
    """
    part = F.struct(*[F.regexp_extract("_file", x, 1).cast("int") for x in (r"^part-(\d+)", r"-c(\d+)\.")])
    files = rows.groupBy("_file").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = files.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_file").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(files, "_file").withColumn("start", F.col("_before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return out.drop("_file", "_row", "_before")


#: Where a row lies in the files.
PLACE = ["_metadata.file_name as _file", "_metadata.row_index as _row"]


def document_starts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, start) from the metadata columns of the files: no token page is read."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)
    return with_starts(rows.selectExpr("doc_id", "cast(n_tokens as bigint) as n_tokens", *PLACE))


def id_checksums(tokens: DataFrame) -> DataFrame:
    """Replaces `tokens` by ids_crc32: CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    at, schema = tokens.columns.index("tokens"), ", ".join("ids_crc32 long" if c == "tokens" else f"{c} {t}" for c, t in tokens.dtypes)

    def sums(batches):
        for batch in batches:
            lists = batch.column(at)
            bounds, ids = np.asarray(lists.offsets), np.asarray(lists.values).astype("<u4")
            crc = pa.array([zlib.crc32(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.int64())
            columns = [crc if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, ["ids_crc32" if i == at else n for i, n in enumerate(batch.schema.names)])

    return tokens.mapInArrow(sums, schema)


def token_report(docs: DataFrame, tokenizer_path: str, end_id: int = 2, path: str | None = None, **columns) -> DataFrame:
    """Writes the token file and reads it back: doc_id, start, n_tokens, ids_crc32 per document.

    Null and empty texts hold the end id alone. Rows that repeat a doc_id get a line each, their
    starts following each other as the file has them. An empty table gives no rows. Extra columns
    are ignored.
    """
    spark = docs.sparkSession
    path = write_tokens(docs, tokenizer_path, path or scratch(spark), end_id, **columns)
    rows = spark.read.schema(FILE_SCHEMA).parquet(path).selectExpr("doc_id", "cast(n_tokens as bigint) as n_tokens", "tokens", *PLACE)
    return with_starts(materialize(id_checksums(rows))).select("doc_id", "start", "n_tokens", "ids_crc32")
