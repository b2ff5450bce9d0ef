"""Sizes of texts in tokens of a public tokenizer, measured in Arrow batches over whole texts."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import tiktoken
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from evalloom.llm.common import spread_small
from evalloom.session import ship_package

#: A rank file of a public byte-level BPE vocabulary; the path is a parameter everywhere.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: The pattern that splits text before the merges of the rank files. Fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

PROMPT = re.compile(r".*?(?:[.!?](?=\s)|[。！？\n]|\Z)", re.DOTALL)
LETTER = re.compile(r"[^\W\d_]")


def shipped(spark: SparkSession, path: str) -> str:
    """Name under which the workers of every executor find the rank file; sent from the driver, once a Spark context."""
    sc = spark.sparkContext
    sent = sc.__dict__.setdefault("_evalloom_files", set())
    if path not in sent:
        sc.addFile(path)
        sent.add(path)
    return os.path.basename(path)


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def measured(docs: DataFrame, text: str, keep: list[str], path: str = RANKS) -> DataFrame:
    """(kept columns, tokens, prompt_tokens, fingerprint, letters): one row a row of ``docs``, in its partitions.

    tokens: of the whole text; 0 for null or empty. prompt_tokens: of its first sentence, the part of instruction data that bears no loss.
    fingerprint: 128 bits of the text up to case and white space, null where there is none. letters: share of its characters
    that are letters. ``keep`` must not hold these names.
    """
    ship_package(docs.sparkSession)
    slim = spread_small(docs.select(*keep, text))
    name = shipped(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(SparkFiles.get(name))
        for pdf in batches:
            rows = []
            for t in pdf[text]:
                if not isinstance(t, str) or not t:
                    rows.append((0, 0, None, 0.0))
                    continue
                n = len(enc.encode_ordinary(t))
                p = min(n, len(enc.encode_ordinary(PROMPT.match(t).group())))
                plain = " ".join(t.lower().split())
                rows.append((n, p, xxhash.xxh3_128_hexdigest(plain) if plain else None, len(LETTER.findall(t)) / len(t)))
            extra = pd.DataFrame(rows, columns=["tokens", "prompt_tokens", "fingerprint", "letters"], index=pdf.index)
            yield pd.concat([pdf[keep], extra], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != text)
    return slim.mapInPandas(run, f"{schema}, tokens bigint, prompt_tokens bigint, fingerprint string, letters double")
