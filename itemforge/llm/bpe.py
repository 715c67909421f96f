"""Byte-level BPE by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be merged over, so a
cut there is certain: the fragments on both sides are encoded independently and their ids
concatenated.  Cuts are taken only where the pre-tokenizer of the vocabulary cannot look across
either (the byte before is not white space, the byte after starts a character and is no
apostrophe).  Every text is cut, at the first certain cut after each ``fragment_bytes`` bytes, which bounds
the work of each merge however long a text is.

Fragments are encoded by the ``tiktoken`` engine loaded with this vocabulary's merges as ranks.
A fragment in which its character classes might differ from those of ``tokenizers`` (rare characters) or
a special token's string occurs is encoded by the ``tokenizers`` library, and no cut touches such a
string.  Tests hold both ways against ``tokenizers``.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemforge.llm import textkit as tk
from itemforge.llm.shared import pick

# The public pre-tokenization pattern of this vocabulary, and its contractions.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

#: Characters on whose class all libraries agree; other texts take the slower way.
PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-ſ‐-‧€]")
#: Last bytes of white space characters in UTF-8.
SPACE_ENDS = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, *range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]
FRAGMENT_BYTES = 128


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for each byte: printable ones stand for themselves."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str, fragment_bytes: int = FRAGMENT_BYTES):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        table = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.special.items()}
        size = max(table) + 1
        self.length = np.array([len(table.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.bytes = np.frombuffer(b"".join(table.get(i, b"") for i in range(size)), np.uint8)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        order = [spec["model"]["vocab"][a + b] for a, b in merges]
        usual = order == sorted(order) and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not spec["normalizer"]
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if usual else None
        self.unusual = re.compile("|".join([PLAIN.pattern, *map(re.escape, self.special)]))
        self.fragment_bytes = fragment_bytes
        self.cuts = self.certain_cuts(list(ranks)) if usual else np.zeros(1 << 16, dtype=bool)

    @staticmethod
    def certain_cuts(tokens: list[bytes]) -> np.ndarray:
        """By left * 256 + right byte: whether a cut between them is certain."""
        joined = np.frombuffer(b"".join(tokens), np.uint8).astype(np.int64)
        last = np.cumsum([len(t) for t in tokens]) - 1
        inner = np.ones(len(joined), dtype=bool)
        inner[last] = False
        at = np.flatnonzero(inner)
        cut = np.ones(1 << 16, dtype=bool)
        cut[joined[at] * 256 + joined[at + 1]] = False
        cut = cut.reshape(256, 256)
        for c in CONTRACTIONS:
            for a, b in zip(c.encode(), c.encode()[1:], strict=False):
                cut[a, b] = False
        cut[SPACE_ENDS, :] = False
        cut[:, 0x80:0xC0] = False
        cut[:, 0x27] = False
        return cut.ravel()

    def whole(self, raw: bytes, at: np.ndarray) -> np.ndarray:
        """Those of the cuts that neither divide nor touch a special token's string."""
        touched = np.zeros(len(raw) + 2, dtype=np.int64)
        for s in map(str.encode, self.special):
            i = raw.find(s)
            while i >= 0:
                touched[i] += 1
                touched[i + len(s) + 1] -= 1
                i = raw.find(s, i + 1)
        return at[np.cumsum(touched)[at] == 0]

    def fragments(self, raw: bytes, special: bool = False) -> list[str]:
        """Pieces of valid UTF-8: the text cut at the first certain cut in each further ``fragment_bytes`` bytes."""
        n = len(raw)
        if n <= self.fragment_bytes:
            return [raw.decode()]
        b = np.frombuffer(raw, np.uint8).astype(np.int64)
        at = np.flatnonzero(self.cuts[b[:-1] * 256 + b[1:]]) + 1
        if special:
            at = self.whole(raw, at)
        slot = at // self.fragment_bytes
        first = np.ones(len(at), dtype=bool)
        first[1:] = slot[1:] != slot[:-1]
        ends = [0, *at[first & (slot > 0)].tolist(), n]
        return [raw[i:j].decode() for i, j in zip(ends, ends[1:], strict=False)]

    def encode(self, raw: bytes) -> np.ndarray:
        """Ids (unsigned 32 bits) of one text."""
        if not raw:
            return np.empty(0, np.uint32)
        text = raw.decode("utf-8", "replace")
        if self.fast is not None and not self.unusual.search(text):
            got = [self.fast.encode_to_numpy(x, disallowed_special=()) for x in self.fragments(text.encode())]
        else:
            got = [self.exactly(x) if self.fast is None or self.unusual.search(x) else self.fast.encode_to_numpy(x, disallowed_special=()) for x in self.fragments(text.encode(), special=True)]
        return (np.concatenate(got) if len(got) > 1 else got[0]).astype(np.uint32)

    def exactly(self, text: str) -> np.ndarray:
        """Ids by the ``tokenizers`` library."""
        return np.array(self.exact.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; bytes that form no character become U+FFFD."""
        ids = ids.astype(np.int64)
        raw = self.bytes[tk.spread(self.begin[ids], self.length[ids])].tobytes()
        return raw.decode("utf-8", "replace").encode()


@lru_cache(maxsize=4)
def byte_bpe(path: str, fragment_bytes: int = FRAGMENT_BYTES) -> ByteBpe:
    return ByteBpe(path, fragment_bytes)


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", fragment_bytes: int = FRAGMENT_BYTES) -> DataFrame:
    """Encode every whole text: (id, ids binary of little-endian unsigned 32-bit ids).

    One pass without a shuffle. Null and empty texts give no ids; null or repeated ids and any
    further columns are no obstacle: a row in, a row out. ``vocabulary`` is a path that every
    executor has.
    """
    src = pick(docs, id_col, text_col).toDF("id", "text")
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches):
        import pyarrow as pa

        bpe = byte_bpe(vocabulary, fragment_bytes)
        for b in batches:
            data, off = tk.column_bytes(b.column("text"))
            for i, j in tk.chunks(off):
                ids = [bpe.encode(data[off[k] : off[k + 1]].tobytes()) for k in range(i, j)]
                sizes = np.cumsum([0, *(4 * len(x) for x in ids)])
                flat = np.concatenate(ids).astype("<u4").view(np.uint8) if ids else np.empty(0, np.uint8)
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), tk.binary_array(flat, sizes)], ["id", "ids"])

    out = src.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(encode, f"id {kind}, ids binary")
    return out.withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Decode ids, special tokens included: (id, ids, text).

    Null and empty ids decode to an empty text; a row in, a row out, whatever its id; further columns are
    left out. Bytes that form no character become U+FFFD, as in the library.
    """
    src = pick(encoded, id_col, ids_col).toDF("id", "ids")
    kind = encoded.schema[id_col].dataType.simpleString()

    def decode(batches):
        import pyarrow as pa

        bpe = byte_bpe(vocabulary)
        for b in batches:
            data, off = tk.column_bytes(b.column("ids"))
            for i, j in tk.chunks(off):
                texts = [bpe.decode(np.frombuffer(data[off[k] : off[k + 1]].tobytes(), "<u4")) for k in range(i, j)]
                yield pa.RecordBatch.from_arrays([b.column("id").slice(i, j - i), b.column("ids").slice(i, j - i), pa.array([x.decode() for x in texts], pa.string())], ["id", "ids", "text"])

    return src.mapInArrow(decode, f"id {kind}, ids binary, text string").toDF(id_col, ids_col, "text")
