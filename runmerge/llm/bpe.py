"""BPE encoding and decoding by dynamic programming over prefixes.

The BPE code of a prefix is that of a shorter prefix plus one last token, and there is only one such token: of
the tokens that are suffixes of the prefix, the one that is compatible with the last token of what stands before
it. An automaton over the vocabulary yields those suffixes, a test of the two tokens' merge histories decides
compatibility, and back-pointers from the whole word give its ids. No merge is ever carried out.

The last symbol of a word carries the end mark, so it is a symbol of its own.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from operator import itemgetter

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of each of a worker's caches (pieces between white space, words, pairs); a full one is emptied.
CACHE = 200_000
#: Below this, letters are those of every Unicode version, so a piece of letters only is one word.
PLAIN = "\u0250"
#: Characters of output after which a batch is passed on.
BATCH_CHARS = 4 << 20
NEVER = 1 << 62


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: Latin-1's own, else from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class Bpe:
    """A byte-level BPE with an end-of-word mark, from a ``tokenizers`` file.

    It takes files with NFC, white-space and lower-case normalisers, a splitting pattern whose matches are the
    words, byte-level symbols and added tokens that are found in the raw text.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.id_of: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of = {i: t for t, i in (self.id_of | self.special).items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(pattern).findall
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else lambda text: [text]
        self.bytes = dict(enumerate(byte_symbols()))
        self.text_of = {i: str(i) for i in self.token_of}
        self.known: dict[str, tuple[int, str, str]] = {}  # words, with whatever punctuation they stand
        # a merged token's two parts and rank; a pair's rank
        self.made: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        self.shift = max(self.token_of).bit_length()
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = self.id_of[left], self.id_of[right]
            self.rank[a, b] = r
            self.made.setdefault(self.id_of[left + right], (a, b, r))
        self._spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self._fits: dict[int, bool] = {}  # by both tokens in one number
        self.automaton = ahocorasick.Automaton()
        reachable: dict[int, bool] = {}
        for token, i in sorted(self.id_of.items(), key=lambda x: self.made.get(x[1], (0, 0, -1))[2]):
            made = self.made.get(i)
            reachable[i] = made is None or (reachable[made[0]] and reachable[made[1]] and self._meets(made[0], made[1]) == made[2])
            symbols = self.symbols(token)
            if symbols and reachable[i]:
                self.automaton.add_word(symbols, (i, len(symbols)))
        self.automaton.make_automaton()
        self.cache = _Cache(self)

    def symbols(self, token: str) -> str:
        """A token as a string with one character a symbol; a symbol with the end mark is moved up by 4096."""
        if token.endswith(self.end):
            token = token[: -len(self.end)]
            return token[:-1] + chr(ord(token[-1]) + 4096) if token else ""
        return token

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """How the left (0) or right (1) edge of a token grew: each edge token, and the rank at which it was merged on."""
        found = self._spines.get((token, side))
        if found is None:
            made = self.made.get(token)
            found = [(token, NEVER)] if made is None else [*((t, r if r != NEVER else made[2]) for t, r in self.spine(made[side], side)), (token, NEVER)]
            self._spines[token, side] = found
        return found

    def _meets(self, a: int, b: int) -> int:
        """The rank of the merge across the border of a and b that BPE would carry out, or -1.

        Ranks grow along an edge, so rank is time. Two edge tokens stand beside each other while neither is
        merged on; the pair merges then if its rank is below that of the left one's next merge (which is
        further left, and so first if equal) and not above that of the right one's.
        """
        left, right, i, j = self.spine(a, 1), self.spine(b, 0), 0, 0
        while True:
            (x, until_x), (y, until_y) = left[i], right[j]
            r = self.rank.get((x, y), -1)
            if r >= 0 and r < until_x and r <= until_y:
                return r
            if until_x == until_y == NEVER:
                return -1
            if until_x <= until_y:
                i += 1
            else:
                j += 1

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b, each whole, beside each other."""
        known = self._fits.get(a << self.shift | b)
        if known is None:
            if len(self._fits) >= CACHE:
                self._fits.clear()
            known = self._fits[a << self.shift | b] = self._meets(a, b) < 0
        return known

    def encode_word(self, word: str) -> list[int]:
        # printable ASCII stands for itself
        symbols = word if word.isascii() and word.isprintable() and " " not in word else word.encode().decode("latin-1").translate(self.bytes)
        symbols = symbols[:-1] + chr(ord(symbols[-1]) + 4096)
        n = len(symbols)
        tokens, lengths = [-1] * (n + 1), [0] * (n + 1)  # the last token of each prefix
        fits, shift = self._fits.get, self.shift
        for at, (token, length) in self.automaton.iter(symbols):
            at += 1
            if tokens[at] >= 0:
                continue
            if length != at:
                before = tokens[at - length]
                if before < 0:
                    continue
                known = fits(before << shift | token)
                if not (self.fits(before, token) if known is None else known):
                    continue
            tokens[at], lengths[at] = token, length
        ids = []
        while n:
            ids.append(tokens[n])
            n -= lengths[n]
        return ids[::-1]

    def _entry(self, ids: list[int]) -> tuple[int, str, str]:
        return len(ids), " ".join([self.text_of[i] for i in ids]), self.decode(ids)

    def _word(self, word: str) -> tuple[int, str, str]:
        known = self.known.get(word)
        if known is None:
            known = self._entry(self.encode_word(word))
            if len(word) < 100:
                if len(self.known) >= CACHE:
                    self.known.clear()
                self.known[word] = known
        return known

    def _lowered(self, part: str) -> str:
        part = unicodedata.normalize("NFC", part)
        # a final sigma is lowered by itself, so that no rule looks at what stands around
        return "".join([c.lower() for c in part]) if "Σ" in part else part.lower()

    def piece(self, piece: str) -> tuple[int, str, str]:
        """Number of ids, ids and decoded tokens of what stands between white space."""
        low = piece.lower() if piece.isascii() else self._lowered(piece)
        if low.isalpha() and max(low) < PLAIN:
            return self._word(low)
        parts = []
        for part in self.specials(piece) if any(map(piece.__contains__, self.special)) else [piece]:
            if part in self.special:
                parts.append(self._entry([self.special[part]]))
            elif part:
                parts += map(self._word, self.words(self._lowered(part)))
        if len(parts) == 1:
            return parts[0]
        return sum([p[0] for p in parts]), " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])

    def pieces(self, text: str) -> list[str]:
        """Splits at white space, which no token spans."""
        return [p for p in regex.split(r"\p{White_Space}+", text) if p] if any(map(text.__contains__, ODD)) else text.split()

    def encode_text(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids and decoded tokens, both joined by one space. Pieces come from the cache."""
        found = list(map(self.cache.__getitem__, self.pieces(text)))
        if self.cache.blank:
            found = [f for f in found if f[0]]
        return sum(map(_COUNT, found)), " ".join(map(_IDS, found)), " ".join(map(_DECODED, found))

    def forget(self) -> None:
        """Empties the cache of pieces, so that its memory serves what the worker does next; words stay known."""
        self.cache.clear()
        self.cache.old = {}

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.encode_text(text)[1].split()]

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens joined by one space, as a file without a decoder asks for. Ids without a token are left out."""
        return " ".join([self.token_of[i] for i in ids if i in self.token_of])


ODD = "\x1c\x1d\x1e\x1f"  # str.split() takes them for white space
_COUNT, _IDS, _DECODED = map(itemgetter, range(3))


class _Cache(dict):
    """What ``Bpe.piece`` has for a piece. What was not used since the last but one filling is forgotten."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self.bpe, self.old = bpe, {}
        self.blank = False  # whether some piece had no ids

    def __missing__(self, piece: str) -> tuple[int, str, str]:
        found = self.old.get(piece)
        if found is None:
            found = self.bpe.piece(piece)
            self.blank = self.blank or not found[0]
        if len(piece) < 100:
            if len(self) >= CACHE:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, text_col: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``carry`` columns of each row, and ``n_tokens, ids, decoded`` of its text.

    ``ids`` holds the decimal ids joined by one space, ``decoded`` what decoding them gives. The vocabulary file
    at ``path`` must be at the same place on every machine. A null text counts as empty and has no ids. Texts
    are encoded whole; repeated rows are rows; an empty table gives none. A carried column may have any name: the
    three new columns come last, and a carried column with one of their names is replaced.
    """
    new = {"n_tokens": "bigint", "ids": "string", "decoded": "string"}
    carry = [c for c in carry if c not in new]
    names = [f"_c{i}" for i in range(len(carry))]
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), *(F.col(c).alias(n) for c, n in zip(carry, names, strict=True)))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[1:]] + [f"{k} {v}" for k, v in new.items()])
    columns = [*names, *new]

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            at, size, counts, ids, decoded = 0, 0, [], [], []
            for row in range(batch.num_rows):
                for into, value in zip((counts, ids, decoded), bpe.encode_text(batch.column(0)[row].as_py() or ""), strict=True):
                    into.append(value)
                size += len(ids[-1]) + len(decoded[-1])
                if size >= BATCH_CHARS or row == batch.num_rows - 1:
                    carried = batch.slice(at, row + 1 - at).columns[1:]
                    yield pa.RecordBatch.from_arrays([*carried, pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], columns)
                    at, size, counts, ids, decoded = row + 1, 0, [], [], []
        bpe.forget()

    out = rows.mapInArrow(apply, schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(carry, names, strict=True)), *new)
