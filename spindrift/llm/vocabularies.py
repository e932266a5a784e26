"""Ids of whole texts by public tokenizers, in numpy, exactly as the tokenizers' own libraries give them.

The quick ways are taken only for texts of ``PLAIN`` characters without very
long words.  Their classes as letters, numbers and white space are the same in
every edition of the character tables that the libraries may carry, and they
stand for themselves in every normal form; all other texts go to the libraries
as they are.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import pairwise

import numpy as np

PLAIN = re.compile("[\t\n\r\x20-\x7e¡-§©«¬®°±¶·»¿-ſ‐‒-—‘-‚“-„•€]*")
LONG = 1000
LONG_SPACE = re.compile(r"\s{%d}" % LONG)
UNITS = re.compile(" +[^ ]*|[^ ]+")
CACHE = 200_000
# Fixed value: the word pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def is_plain(text: str) -> bool:
    if PLAIN.fullmatch(text) is None:
        return False
    return len(text) < LONG or len(max(text.split(), key=len, default="")) < LONG and LONG_SPACE.search(text) is None


def byte_letters() -> dict[str, int]:
    """The printable character by which a byte-level vocabulary writes each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteVocabulary:
    """A byte-level vocabulary; texts of special tokens are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.ranked = self._ranked(path)

    def _ranked(self, path: str):
        """The same vocabulary by ranks, if its ids follow the order of merges and its words are those of the pattern."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model, words = held["model"], held.get("pre_tokenizer") or {}
        if words.get("type") != "ByteLevel" or words.get("add_prefix_space") or not words.get("use_regex", True) or held.get("normalizer"):
            return None
        vocabulary, byte = model["vocab"], byte_letters()
        merged = [vocabulary.get("".join(m if isinstance(m, list) else m.split(" ", 1))) for m in model.get("merges", [])]
        if None in merged or any(a >= b for a, b in pairwise(merged)) or not vocabulary.keys() >= byte.keys():
            return None
        if model.get("ignore_merges") or merged and merged[0] <= max(vocabulary[c] for c in byte):
            return None
        kept = {vocabulary[c] for c in byte} | set(merged)
        ranks = {bytes(byte[c] for c in word): i for word, i in vocabulary.items() if i in kept}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if self.ranked is not None and is_plain(text):
            return np.array(self.ranked.encode_ordinary(text), np.int32)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def entries(self) -> list[bytes]:
        """The bytes of each id."""
        byte = byte_letters()
        names = {i: word for word, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        added = set(self.tokenizer.get_added_tokens_decoder())
        words = [names.get(i, "") for i in range(max(names) + 1)]
        return [
            w.encode() if i in added or not byte.keys() >= set(w) else bytes(byte[c] for c in w) for i, w in enumerate(words)
        ]


class PieceVocabulary:
    """A vocabulary of pieces that writes a space as U+2581 and puts one before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        # A space behind the last word is a unit that the model puts before a text by itself.
        self.known: dict[str, bytes] = {" ": array("i", [self.model.piece_to_id("▁")]).tobytes()}
        words = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        # No piece goes on behind a word, and white space is kept: then units between words stand alone.
        probe = "a  b \n c   "
        spelled = "".join(words[i] for i in self.model.encode(probe)).replace("<0x0A>", "\n").replace("▁", " ")
        self.by_unit = not any("▁" in word.lstrip("▁") for word in words) and spelled == " " + probe

    def _unit(self, unit: str) -> bytes:
        ids = array("i", self.model.encode(unit[1:])).tobytes()
        if len(self.known) < CACHE and len(unit) < 64:
            self.known[unit] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        if not self.by_unit or not is_plain(text):
            return np.array(self.model.encode(text), np.int32)
        units = UNITS.findall(" " + text)
        found = list(map(self.known.get, units))
        i = -1
        for _ in range(found.count(None)):
            i = found.index(None, i + 1)
            found[i] = self.known.get(units[i]) or self._unit(units[i])
        return np.frombuffer(b"".join(found), np.int32)

    def entries(self) -> list[bytes]:
        """The bytes of each id."""
        m = self.model
        return [
            bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode()
            for i in range(m.get_piece_size())
        ]
