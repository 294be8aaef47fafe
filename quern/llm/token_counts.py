"""Token counts by a map-side two-tier lookup.

Tier one is a compact broadcast table of frequent pre-tokens and their token
counts. It holds the vocabulary's own entries that are whole pre-tokens: the
strings the tokenizer's training found frequent, so it needs no pass over the
corpus and its size is bounded by the vocabulary. Tier two encodes misses with
the tokenizer itself, through a bounded cache that a Python worker keeps from
task to task. Nothing is shuffled: one scan, one projection.

Texts are split as the tokenizer splits them. Where a character is outside the
blocks for which the two Unicode tables are known to agree, only the stretch
between two plain spaces that holds it goes to tier two as one piece.

Null and empty texts have 0 tokens. Special strings inside texts are one token
each, as the library does by default. Very long pre-tokens are encoded whole and
not cached. Repeated rows get the same counts; an empty table gives an empty
result. Columns of the input that are named like a new one keep their values
under that name with ``_input`` behind it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import added

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE, CACHED_CHARS = 1 << 17, 64
#: Characters outside these blocks (Latin, Greek, Cyrillic, dashes and quotes, Han, kana, Hangul syllables) are split by the library, whose Unicode tables may differ from regex's.
_RARE = regex.compile(r"[^\x00-ɏͰ-ϿЀ-ӿ‐-‧\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fef\uac00-\ud7a3]")
#: A place before a single space between plain characters: always a bound of pre-tokens.
_BOUND = regex.compile(r"(?<=[!-~])(?= [!-~])", regex.V1)


def _byte_chars() -> dict[str, int]:
    """The printable characters by which byte-level vocabularies spell bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def frequent_table(tokenizer) -> tuple[str, bytes]:
    """(pre-tokens joined by NUL, one count byte each): the vocabulary's whole pre-tokens."""
    spelled, split = _byte_chars(), regex.compile(PATTERN)
    found = []
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        try:
            s = bytes(spelled[c] for c in entry).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if s and "\0" not in s and not _RARE.search(s) and (m := split.fullmatch(s)) and split.match(s).end() == m.end():
            found.append(s)
    counts = [len(e.ids) for e in tokenizer.encode_batch(found, add_special_tokens=False)]
    kept = [(s, n) for s, n in zip(found, counts, strict=True) if n < 256]
    return "\0".join(s for s, _ in kept), bytes(n for _, n in kept)


def token_counter(tokenizer, table: tuple[str, bytes] | None = None):
    """A function from a text to its number of tokens."""
    split = regex.compile(PATTERN).findall
    first = dict(zip(table[0].split("\0"), table[1], strict=True)) if table and table[1] else {}
    special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    cut_at = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def encode(piece: str) -> int:
        return len(tokenizer.encode(piece, add_special_tokens=False).ids)

    cached = lru_cache(maxsize=CACHE)(encode)

    def count(text: str | None) -> int:
        if not text:
            return 0
        n, parts = 0, [text]
        if cut_at is not None and cut_at.search(text):
            parts = cut_at.split(text)
            n = len(parts) - 1
        for part in parts:
            for stretch in _BOUND.split(part) if _RARE.search(part) else (part,):
                for piece in (stretch,) if _RARE.search(stretch) else split(stretch):
                    k = first.get(piece)
                    n += k if k is not None else cached(piece) if len(piece) <= CACHED_CHARS else encode(piece)
        return n

    return count


_KEPT: dict = {}


def _kept_counter(key: str, spec: str, frequent: tuple[str, bytes]):
    """This process's counter of that key; a worker keeps one, the latest."""
    from tokenizers import Tokenizer

    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = token_counter(Tokenizer.from_str(spec), frequent)
    return _KEPT[key]


def count_tokens(docs: DataFrame, tokenizer_json: str, limit: int = 512) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit to ``docs``. ``tokenizer_json``: path of a byte-level BPE file, read on the driver."""
    from tokenizers import Tokenizer

    with open(tokenizer_json, encoding="utf-8") as f:
        spec = f.read()
    key = hashlib.sha256(spec.encode("utf-8")).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast((spec, frequent_table(Tokenizer.from_str(spec))))  # both bounded by the vocabulary

    @F.pandas_udf(LongType())
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = _kept_counter(key, *shared.value)
        for texts in batches:
            yield pd.Series([count(t) for t in texts], dtype="int64")

    text = F.coalesce(F.col("text"), F.lit(""))
    out = added(docs, n_bytes=F.octet_length(text).cast("long"), n_tokens=tokens(text))
    return added(out, over_limit=F.col("n_tokens") > limit)


def op8_token_counts(spark, sf_dir) -> DataFrame:
    import public_tokenizers

    from ..session import share_code, table

    share_code(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")
