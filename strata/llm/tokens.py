"""Exact, cached encoders for two kinds of public BPE vocabulary files.

A text is cut at blanks where every encoder of that vocabulary must also cut; pieces are looked up in a bounded cache and
only unseen pieces are encoded. Results equal the tokenizers library's encode(text, add_special_tokens=False)."""

from __future__ import annotations

import functools
import json
import re
import struct
from array import array
from collections.abc import Callable

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Distinct pieces that a worker keeps; later ones are encoded each time.
CACHE_PIECES = 250_000
#: Marks that often end a word: behind letters they are a piece of their own in both vocabularies.
_ENDS = ".,;:!?$*)]}\"%"
#: A blank that is not followed by a visible character doesn't end a piece.
_NO_CUT = re.compile(r" (?=\s|\Z)")


_PACK = [struct.Struct(f"<{n}I").pack for n in range(33)]


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return _PACK[len(ids)](*ids) if len(ids) < 33 else array("I", ids).tobytes()


class _Cache(dict):
    def __init__(self, make: Callable, limit: int) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, piece):
        value = self.make(piece)
        if len(self) < self.limit:  # frequent pieces come early; rare ones are encoded each time
            self[piece] = value
        return value


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies show printable bytes as themselves and the others as characters from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def pieces(text: str) -> list[str]:
    """The text cut before each blank that a visible character follows: exact cuts for both vocabularies."""
    found = text.split(" ")
    if _NO_CUT.search(text) is None:
        return [found[0], *(" " + x for x in found[1:])]
    out = [found[0]]
    for x in found[1:]:
        if x and not x[0].isspace():
            out.append(" " + x)
        else:
            out[-1] += " " + x
    return out


class _Encoder:
    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES) -> None:
        with open(path, encoding="utf-8") as f:
            source = f.read()
        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(source)
        self.specials = [x["content"] for x in spec["added_tokens"]]
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] or any(map(str.isspace, x["content"])) for x in spec["added_tokens"]):
            raise ValueError("added tokens that take in blanks are not supported")
        self.model = spec["model"]
        self._special = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)").search
        self._marks = tuple({x[0] for x in self.specials})
        self.merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in self.model["merges"]]
        self._after_blank = _Cache(lambda x: self.encode_piece(" " + x), cache_pieces)
        self._other = _Cache(self.encode_piece, 20_000)

    def has_special(self, piece: str) -> bool:
        for mark in self._marks:
            if mark in piece:
                return self._special(piece) is not None
        return False

    def by_library(self, piece: str) -> bytes:
        return np.array(self.library.encode(piece, add_special_tokens=False).ids, "<u4").tobytes()

    def encode_piece(self, piece: str) -> bytes:
        raise NotImplementedError

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if _NO_CUT.search(text) is None:
            first, *rest = text.split(" ")
            return self._other[first] + b"".join(map(self._after_blank.__getitem__, rest))
        return b"".join(self._after_blank[x[1:]] if x[:1] == " " else self._other[x] for x in pieces(text))


class ByteEncoder(_Encoder):
    """Byte-level BPE without normaliser, with the pattern of GPT-2."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES) -> None:
        super().__init__(path, cache_pieces)
        byte, vocab = _byte_of_symbol(), self.model["vocab"]
        ranks = {bytes(byte[c] for c in k): v for k, v in vocab.items() if k not in self.specials}
        #: The bytes of each id.
        self.bytes_of = {v: k for k, v in ranks.items()} | {self.library.token_to_id(x): x.encode() for x in self.specials}
        self.plain = all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(self.merges)) and len(ranks) == 256 + len(self.merges)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("strata", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if self.plain else None
        self.core = self.fast._core_bpe.encode_ordinary if self.plain else None
        self.single = self.fast._core_bpe.encode_single_piece if self.plain else None

    def encode_piece(self, piece: str) -> bytes:
        if self.core is None or self.has_special(piece):
            return self.by_library(piece)
        if piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha()):
            return packed(self.single(piece.encode()))
        stem = piece.rstrip(_ENDS)
        if stem != piece and stem[1:].isalpha() and (stem[0] == " " or stem[0].isalpha()):
            return self._after_blank[stem[1:]] + self._other[piece[len(stem) :]] if stem[0] == " " else self._other[stem] + self._other[piece[len(stem) :]]
        return packed(self.core(piece))

    def decode(self, ids: bytes) -> bytes:
        """The bytes that the ids stand for, from the vocabulary."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


#: Characters for which lower case, composition and the classes of letters and digits are alike in every library.
_COMMON = re.compile("[\t-\r -~À-įı-ſ]*")
_WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class WordEncoder(_Encoder):
    """BPE with word ends over lower-cased, composed text; white space is dropped."""

    END = b"\xff"  # stands for the end of a word: no byte of UTF-8

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES) -> None:
        super().__init__(path, cache_pieces)
        byte, vocab, suffix = _byte_of_symbol(), self.model["vocab"], self.model["end_of_word_suffix"]

        def raw(token: str) -> bytes:
            return bytes(byte[c] for c in token.removesuffix(suffix)) + self.END * token.endswith(suffix)

        singles = [s for s in byte if s in vocab and s + suffix in vocab]
        self.plain = len(singles) == 256
        self.fast, ranks, ids = None, {}, []
        if self.plain:
            # A byte joins the end of its word first, then merges come in the order of the file.
            for token in [s + suffix for s in singles] + singles + [a + b for a, b in self.merges]:
                ranks[raw(token)] = len(ids)
                ids.append(vocab[token])
            self.plain = len(ranks) == len(ids)
        if self.plain:
            self.fast = tiktoken.Encoding("strata", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
            self.ids = ids
            self.core = self.fast._core_bpe.encode_single_piece

    def encode_piece(self, piece: str) -> bytes:
        if self.fast is None or _COMMON.fullmatch(piece) is None or self.has_special(piece):
            return self.by_library(piece)
        ids, core, word = self.ids, self.core, piece.lower().strip()
        if word.isalpha():
            found = (word,)
        elif (stem := word.rstrip(_ENDS)).isalpha():
            found = (stem, word[len(stem) :])
        else:
            found = _WORDS.findall(word)
        return packed([ids[x] for w in found for x in core(w.encode() + self.END)])


@functools.lru_cache(4)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


@functools.lru_cache(4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def vocabulary(name: str) -> str:
    """The default place of a public vocabulary file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
