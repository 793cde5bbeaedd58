"""Tokenization for the operators that need ids, with a cache of space-separated pieces.

The vocabulary's splitting rule never lets a token reach across a single space between two other
characters, or across a single line feed between two, so a text's ids are the ids of its pieces
one after another. Pieces repeat far more than texts do, so most of a text is dictionary look-ups
and one gather. A text with other white space (two spaces in a row, tabs and so on) is handed to
the tokenizer whole. New pieces are encoded from the rank file that lies beside the tokenizer's
file, if there is one, as that costs less a call. Ids are equal either way; the tests compare them.

The strings of special tokens in a text are ordinary text if ``ordinary`` is set; else they are the
special tokens, as in a tokenizer with nothing set, and texts that hold one are handed over whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Sequence

import numpy as np

#: Cached pieces of a worker; beyond it the cache starts anew, which changes only the speed.
CACHE_PIECES = 400_000
#: The same, and the texts that are worked on at once, where a worker has to be small.
FEW_PIECES, FEW_TEXTS = 1 << 16, 64
_START = "\x01"
_by_path: dict[tuple[str, bool, bool], PieceTokenizer] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer(path: str, ordinary: bool = True, small: bool = False) -> PieceTokenizer:
    """One per worker process, path, reading of special tokens' strings and size."""
    if (path, ordinary, small) not in _by_path:
        _by_path[path, ordinary, small] = PieceTokenizer(path, ordinary, small)
    return _by_path[path, ordinary, small]


class _Numbers(dict):
    """Numbers keys in order of first sight."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


class PieceTokenizer:
    def __init__(self, path: str, ordinary: bool = True, small: bool = False) -> None:
        self.cached, self.at_once = (FEW_PIECES, FEW_TEXTS) if small else (CACHE_PIECES, None)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = ordinary
        self.special = [] if ordinary else [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.piece = self._ranked(f"{path.removesuffix('.json')}.tiktoken")
        self._clear()

    def _ranked(self, path: str) -> Callable[[str], Sequence[int]]:
        """Encodes one piece, by the rank file if it is there, else by the tokenizer itself."""
        if not os.path.exists(path):
            return lambda text: self.whole.encode(text, add_special_tokens=False).ids
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.starts = np.empty(1 << 14, np.int64)
        self.lengths = np.empty(1 << 14, np.int64)
        self.odd = np.empty(1 << 14, bool)
        self.known = 0

    def _learn(self) -> None:
        """Ids of the pieces that were numbered but not yet encoded."""
        new = list(self.numbers)[self.known :] if self.known == 0 else self._tail()
        if not new:
            return
        texts = [key[1:] if key[:1] == _START else key if key == "\n" else " " + key for key in new]
        encoded = list(map(self.piece, texts))
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        ids = np.fromiter((i for e in encoded for i in e), np.uint32, int(lengths.sum()))
        odd = [not key.isprintable() and self._is_odd(key) or not key for key in new]
        end = self.known + len(new)
        for name in ("starts", "lengths", "odd"):
            if len(getattr(self, name)) < end:
                setattr(self, name, np.resize(getattr(self, name), 2 * end))
        if len(self.flat) < self.used + len(ids):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.starts[self.known : end] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.known : end], self.odd[self.known : end] = lengths, odd
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known = end

    @staticmethod
    def _is_odd(key: str) -> bool:
        """Whether a piece is empty or has white space, other than a line feed alone."""
        bare = key.removeprefix(_START)
        return key != "\n" and (not bare or _START in bare or any(map(str.isspace, bare)))

    def _tail(self) -> list[str]:
        tail, keys = [], reversed(self.numbers)
        for _ in range(len(self.numbers) - self.known):
            tail.append(next(keys))
        return tail[::-1]

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each text (null: none) without special tokens, as uint32 arrays."""
        if self.at_once is None:
            return self._encode(texts)
        # copies, as the ids of a text alone would hold those of all texts worked on with it
        return [ids.copy() for at in range(0, len(texts), self.at_once) for ids in self._encode(texts[at : at + self.at_once])]

    def _encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        if self.known > self.cached:
            self._clear()
        pieces: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        plain = np.ones(len(texts), bool)
        for n, text in enumerate(texts):
            if text:
                if _START in text or any(s in text for s in self.special):
                    plain[n] = False
                else:
                    pieces += (_START + (text.replace("\n", f" \n {_START}") if "\n" in text else text)).split(" ")
            ends[n + 1] = len(pieces)
        which = np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))
        self._learn()
        lengths = self.lengths[which]
        stops = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.flat[np.repeat(self.starts[which] - stops[:-1], lengths) + np.arange(stops[-1])]
        odd = np.concatenate([[0], np.cumsum(self.odd[which])])
        plain &= odd[ends[1:]] == odd[ends[:-1]]
        bounds = stops[ends]
        return [
            ids[bounds[n] : bounds[n + 1]] if plain[n] else np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
            for n, text in enumerate(texts)
        ]
