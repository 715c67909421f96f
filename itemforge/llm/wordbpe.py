"""Encoder for word-level BPE vocabularies whose last symbol of a word carries an end mark.

The ``tiktoken`` engine knows no end mark, so the words are joined by one control character that
stands for it: "the</w>" becomes the bytes "the" and 0x01, with the vocabulary's own ids as ranks
(the bytes with an end mark rank before every merge, so that merge always comes first). Texts with
rare characters or a special token's string go through the ``tokenizers`` library itself.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from itertools import repeat

import numpy as np

from itemforge.llm.bpe import byte_letters
from itemforge.llm.textkit import spread

END = "\x01"
#: Words whose ids an encoder remembers; others are encoded whenever they come.
REMEMBERED = 200_000
#: Characters that are their own NFC form, have a one-character lower case and undisputed classes.
PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-įı-ſ‐-‧€]")
# The vocabulary's public word pattern.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _class(kind: str) -> str:
    plain = [chr(c) for c in (*range(0x20, 0x180), *range(0x2010, 0x2028), 0x20AC) if unicodedata.category(chr(c))[0] == kind]
    return "".join(map(re.escape, plain))


class WordBpe:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        self.size = max(max(spec["model"]["vocab"].values()), *(t["id"] for t in spec["added_tokens"])) + 1
        letters, suffix = byte_letters(), spec["model"]["end_of_word_suffix"]
        special = [t["content"] for t in spec["added_tokens"]]
        ranks = {}
        for t, i in spec["model"]["vocab"].items():
            if t in special:
                continue
            end = bool(suffix) and t.endswith(suffix) and t != suffix
            raw = bytes(letters[c] for c in (t[: -len(suffix)] if end else t))
            ranks[raw + END.encode() * end] = i
        split = spec["pre_tokenizer"]["pretokenizers"][0].get("pattern", {}).get("Regex") if spec["pre_tokenizer"]["type"] == "Sequence" else None
        usual = suffix == "</w>" and split == WORD and [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self.fast = tiktoken.Encoding("word_bpe", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={}) if usual else None
        self.unusual = re.compile("|".join([PLAIN.pattern, *map(re.escape, special)]))
        self.ends = np.zeros(self.size, dtype=bool)
        self.ends[[i for t, i in ranks.items() if t.endswith(END.encode())]] = True
        self.known: dict[str, int] = {}
        self.ids, self.begin, self.length = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        letter, number = _class("L"), _class("N")
        self.words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^\s{letter}{number}]+")

    def encode(self, raw: bytes) -> np.ndarray:
        """Ids (unsigned 32 bits) of one text, without special tokens around it."""
        text = raw.decode("utf-8", "replace")
        if self.fast is None or self.unusual.search(text):
            return np.array(self.exact.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=np.uint32)
        words = self.words.findall(text.lower())
        if not words:
            return np.empty(0, np.uint32)
        words.append("")
        return self.fast.encode_to_numpy(END.join(words), disallowed_special=()).astype(np.uint32)

    def encode_many(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts one after the other, and the number of each.

        A word's ids do not depend on its neighbours, so each different word of the texts is encoded
        once, and common words once for all. New words are encoded together; every word ends with the
        one id that carries the end mark.
        """
        words: list[str] = []
        count = np.zeros(len(texts), dtype=np.int64)
        exact = {}
        for k, raw in enumerate(texts):
            text = raw.decode("utf-8", "replace")
            if self.fast is None or self.unusual.search(text):
                exact[k] = self.encode(raw)
            else:
                found = self.words.findall(text.lower())
                count[k] = len(found)
                words += found
        at = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        ids, begin, length = self.ids, self.begin, self.length
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = {w: k for k, w in enumerate(dict.fromkeys(words[i] for i in missing), len(begin))}
            got = self.fast.encode_to_numpy(END.join([*new, ""]), disallowed_special=()).astype(np.uint32)
            stop = np.flatnonzero(self.ends[got]) + 1
            start = np.concatenate([[0], stop])[:-1]
            if len(stop) != len(new):
                raise ArithmeticError("a word without its end")
            at[missing] = [new[words[i]] for i in missing]
            begin = np.concatenate([begin, start + len(ids)])
            length = np.concatenate([length, stop - start])
            ids = np.concatenate([ids, got])
            if len(begin) <= REMEMBERED:
                self.known.update(new)
                self.ids, self.begin, self.length = ids, begin, length
        flat = ids[spread(begin[at], length[at])]
        total = np.concatenate([[0], np.cumsum(length[at])])[np.concatenate([[0], np.cumsum(count)])]
        sizes = np.diff(total)
        if not exact:
            return flat, sizes
        parts = [exact.get(k, flat[total[k] : total[k + 1]]) for k in range(len(texts))]
        return np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)


@lru_cache(maxsize=4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
