"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The distinct words of a batch lie in one flat symbol array. Each round finds,
for every word at once, the rank of each neighbouring pair by binary search
over the sorted pair keys, and merges the lowest-ranked pair of each word,
left to right. Words without a known pair leave the array, so later rounds
touch only what can still merge.

Cases: null or empty text gives no ids and decodes to "". The string of an
added token inside a text becomes that token, as in the tokenizers library.
Repeated rows give equal results; long texts are never cut. A file with another
split, normalizer or model than byte-level BPE raises.
"""

from __future__ import annotations

import json
import re

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._batches import map_texts

#: Fixed value: the split pattern of byte-level BPE vocabularies of this kind.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts without characters from U+0250 on, where the classes are short enough to write out.
LATIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+| ?[^\t-\r \x85\xa0A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f0-9\xb2\xb3\xb9\xbc-\xbe]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+"
#: Words kept with their ids between batches of one task; beyond it the table starts anew.
KEPT_WORDS = 200_000

SCHEMA = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())])


def byte_chars() -> dict[str, int]:
    """Printable stand-in character -> byte, by the public rule: printable Latin-1 stands for itself, the rest follows from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def supported(spec: dict) -> None:
    """Raises ValueError for files whose parts this module does not follow, rather than giving other ids than the file means."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [
        name
        for name, bad in {
            "model": model.get("type", "BPE") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
            "normalizer": spec.get("normalizer") is not None,
            "pre_tokenizer": before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True),
            "decoder": (spec.get("decoder") or {}).get("type") != "ByteLevel",
            "added_tokens": any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")),
        }.items()
        if bad
    ]
    if wrong:
        raise ValueError(f"unsupported parts of the vocabulary file: {', '.join(wrong)}")


class ByteBPE:
    """A vocabulary file of the tokenizers library (model BPE, byte level)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        supported(spec)
        vocab, chars = spec["model"]["vocab"], byte_chars()
        self.bytes_of: dict[int, bytes] = {i: bytes(chars[c] for c in token) for token, i in vocab.items()}
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.bytes_of |= {i: token.encode() for token, i in self.added.items()}
        self.table = np.array([self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)], object)
        self.first = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.first[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        into = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left << 32 | right
        self.rank = np.argsort(keys, kind="stable")
        self.keys, self.into = keys[self.rank], into
        self.of_bytes = self.ranks((self.first[:, None] << 32 | self.first[None, :]).ravel()).reshape(256, 256)
        self.split, self.latin, self.beyond = regex.compile(SPLIT), re.compile(LATIN), re.compile("[^\0-\u024f]")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.special = {"\0" + x: np.array([i], "<u4").tobytes() for x, i in self.added.items()}
        self.known: dict[str, bytes] = dict(self.special)

    def ranks(self, pair: np.ndarray) -> np.ndarray:
        """Place of each pair in the list of merges, or the list's length."""
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.rank[at], len(self.keys))

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian unsigned 32-bit integers."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        symbols, word = self.first[flat], np.repeat(np.arange(len(words)), sizes)
        none = len(self.keys)
        rank = np.full(symbols.size, none)
        if flat.size:
            rank[:-1] = self.of_bytes[flat[:-1], flat[1:]]
            rank[np.r_[word[1:] != word[:-1], True]] = none
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while symbols.size:
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[starts, word.size])
            lowest = np.minimum.reduceat(rank, starts)
            if (lowest == none).any():
                live = np.repeat(lowest < none, lengths)
                done.append((word[~live], symbols[~live]))
                symbols, word, rank = symbols[live], word[live], rank[live]
                lowest, lengths = lowest[lowest < none], lengths[lowest < none]
            hit = np.flatnonzero(rank == np.repeat(lowest, lengths))
            # Of overlapping hits (a a a) every second one merges, from the left.
            here = np.arange(hit.size)
            fresh = np.r_[True, np.diff(hit) != 1][: hit.size]
            hit = hit[(here - np.maximum.accumulate(np.where(fresh, here, 0))) % 2 == 0]
            symbols[hit] = self.into[rank[hit]]
            keep = np.ones(symbols.size, bool)
            keep[hit + 1] = False
            merged = np.zeros(symbols.size, bool)
            merged[hit] = True
            symbols, word, rank, merged = symbols[keep], word[keep], rank[keep], merged[keep]
            # Only pairs beside a merged symbol have a new rank.
            merged[:-1] |= merged[1:]
            at = np.flatnonzero(merged)
            last = at == symbols.size - 1
            near = np.minimum(at + 1, symbols.size - 1)
            rank[at] = np.where(last | (word[at] != word[near]), none, self.ranks(symbols[at] << 32 | symbols[near]))
        if not done:
            return [b""] * len(words)
        words_out, ids = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
        order = np.argsort(words_out, kind="stable")
        raw, ends = ids[order].astype("<u4").tobytes(), np.cumsum(np.bincount(words_out, minlength=len(words)) * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def words(self, text: str) -> list[str]:
        return self.latin.findall(text) if self.beyond.search(text) is None else self.split.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        parts: list[list[str]] = []
        for t in texts:
            if self.cut and self.cut.search(t):
                out: list[str] = []
                for k, x in enumerate(self.cut.split(t)):
                    out += ["\0" + x] if k % 2 else self.words(x)  # no word of the split pattern looks like that
                parts.append(out)
            else:
                parts.append(self.words(t))
        if len(self.known) > KEPT_WORDS:
            self.known = dict(self.special)
        if new := [x for x in set().union(*parts) if x not in self.known]:
            self.known.update(zip(new, self.merge([x.encode() for x in new]), strict=True))
        return [b"".join([self.known[x] for x in p]) for p in parts]

    def decode(self, ids: bytes) -> str:
        return b"".join(self.table[np.frombuffer(ids, "<u4")].tolist()).decode("utf-8", "replace")


def encode_decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (binary), n_tokens and the text decoded again from the ids.

    ``vocabulary`` is a file that every executor can open.
    """

    def make():
        bpe = ByteBPE(vocabulary)

        def run(texts: list[str]) -> list:
            ids = bpe.encode(texts)
            return [ids, [len(x) // 4 for x in ids], [bpe.decode(x) for x in ids]]

        return run

    return map_texts(df, id_col, text_col, SCHEMA, make)
