"""Token counts through a digest cache.

Every whole text is identified by the SHA-256 of its UTF-8 bytes and every tokenizer by the SHA-256 of
its vocabulary file. A stored table (content digest, tokenizer digest, n_tokens) is joined first; of the
texts it lacks, one copy of each is encoded and its count appended. Null and empty texts are one content;
nothing else is normalised, as white space, case and composition all change what the tokenizer counts.

Counts are those of the ``tokenizers`` library. Texts of plain Latin characters are encoded with the same
byte-level merges by ``tiktoken`` (the same ids, a quarter of the time); any other text goes through
``tokenizers`` itself, and so does one with a stretch that is too long for the splitting pattern's stack.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored, text_or_empty

#: Columns of the stored cache.
CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"

#: Characters on which the two libraries' splitting patterns cannot differ.
_OTHER = re.compile("[^\t\n\r\x20-\x7e¡-©«-¬®-±¶-¸»¿-ɏ–-—‘-„…€]")


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def counter(path: str):
    """A function text -> number of tokens, without added special tokens, truncation or padding."""
    import json

    import tiktoken
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(path)
    exact.no_truncation()
    exact.no_padding()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not model.get("end_of_word_suffix")
    slow = lambda text: len(exact.encode(text, add_special_tokens=False).ids)
    if not plain:
        return slow
    added = {t["content"] for t in spec.get("added_tokens", [])}
    special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
    char_byte = byte_chars()
    ranks = {bytes(char_byte[c] for c in tok): i for tok, i in model["vocab"].items() if tok not in added}
    fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def count(text: str) -> int:
        if _OTHER.search(text) or (special and special.search(text)):
            return slow(text)
        try:
            return len(fast.encode_to_numpy(text, disallowed_special=()))
        except ValueError:  # white space by the hundred thousand
            return slow(text)

    return count


#: The splitting pattern of byte-level vocabularies (a fixed value).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_chars() -> dict[str, int]:
    """Which printable character stands for which byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def cache_folder(spark: SparkSession) -> str:
    """The table of stored counts of all runs of this application, in the shared folder."""
    return f"{shared_dir(spark)}/token-counts"


def stored_counts(spark: SparkSession, cache_path: str) -> DataFrame | None:
    """The rows of a stored cache; None where nothing has been stored yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{cache_path}/*.parquet"))
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path) if found else None


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: DataFrame | None = None, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, content_digest) for each row of ``docs``.

    ``cache``: earlier (content_digest, tokenizer_digest, n_tokens) rows; ``cache_path``: a Parquet table that
    is read as the cache too, and that the counts of what both lack are appended to. A count that two runs
    append at once stands there twice and is read once; what a lost run did not append is encoded again.

    Null texts count as empty: 0 bytes, 0 tokens. Texts are encoded whole, however long. Repeated rows give a
    row each, rows with a null id too. Other columns of ``docs`` are ignored, whatever their names. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    tok = tokenizer_digest(tokenizer_path)
    rows = docs.select(F.col(id_col).alias(id_col), text_or_empty(text_col).alias("_text"))
    keyed = rows.select(id_col, F.octet_length("_text").cast("long").alias("n_bytes"), F.unhex(F.sha2("_text", 256)).alias("content_digest"), "_text")
    earlier = [c.select("content_digest", "tokenizer_digest", "n_tokens") for c in (cache, stored_counts(spark, cache_path) if cache_path else None) if c is not None]
    # copies become one row before they shuffle, also before they meet the cache
    misses = keyed.groupBy("content_digest").agg(F.first("_text").alias("_text"))
    known = None
    if earlier:
        # one count a digest, whatever was appended twice
        every = reduce(DataFrame.unionByName, earlier).filter(F.col("tokenizer_digest") == tok)
        known = stored(every.groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens")), "known")
        misses = misses.join(known.select("content_digest").hint("shuffle_merge"), "content_digest", "left_anti")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(tokenizer_path)
        for b in batches:
            yield pd.DataFrame({"content_digest": b["content_digest"], "tokenizer_digest": tok, "n_tokens": [count(t) for t in b["_text"]]})

    fresh = stored(misses.mapInPandas(encode, CACHE_SCHEMA), "counts")
    if cache_path:
        fresh.write.mode("append").parquet(cache_path)
    counts = fresh.select("content_digest", "n_tokens")
    if known is not None:
        counts = counts.unionByName(known)
    # the copies of one text may be a third of all rows: an inner join, which adaptive execution splits
    return (
        keyed.select(id_col, "n_bytes", "content_digest")
        .join(counts.hint("shuffle_merge"), "content_digest")
        .select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.hex("content_digest").alias("content_digest"))
    )
