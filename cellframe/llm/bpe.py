"""Byte-pair encoding and decoding as a streaming transducer.

Every pre-token is read symbol by symbol. The state is, for the positions in the window, the last token of the
tokenization of everything up to there. It is the one token that ends there, tokenizes to itself, and stays apart from
the last token of the part before it: no merge crosses their border before the pieces beside it have grown on. So a
position needs only tokens that end there, and the tokenization of a prefix is read back along its last tokens.

Let L be the symbols of the longest token that the merge list can make. The token that follows begins after one of the
last L positions, so the tokens on which the L prefixes ending there agree are stable: they are emitted, and only the
rest is kept. L is the lookahead that is computed from the merge list; memory is the window, however long the pre-token.

Normalization and splitting are the definition's own, done by the tokenizers library. Where a definition lower-cases and
splits into words as WORD_SPLIT does, blocks of characters for which Python's tables were found to agree with the
library's (asked for each character below FAST_BELOW when a worker starts) are split in Python, which is faster.

Decoding is a state machine over bytes: pieces of tokens go in, complete UTF-8 characters come out, and an unfinished
character is the only state.

Null text counts as empty and gives no tokens; repeated rows are encoded alike; an empty table gives an empty table."""

from __future__ import annotations

import codecs
import json
import os
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import islice

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm.common import kept, map_rows, sha256_hex

#: Bytes of pre-tokens kept with their tokens in each worker, in two halves: when one is full, the other, with what was
#: not asked for meanwhile, is emptied, which changes no result.
CACHE_BYTES = 48 << 20
#: Pairs of tokens kept with whether they stay apart; emptied when full, too.
PAIRS = 1 << 16
#: Characters of a text that are split into pre-tokens at a time.
BLOCK = 1 << 16
#: Rank of a pair that no merge joins, or of what is never merged.
NONE = 1 << 60
#: Characters below this are asked for at the start; the marks among them have been in Unicode for long.
FAST_BELOW = 0x600
#: Fixed value: the split by which a definition takes letters, single digits and other marks as words.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@lru_cache(1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves,
    the others take the letters from 256 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + k)
    return [letters[b] for b in range(256)]


class MergeList:
    """Merges by rank (lowest first, leftmost first among equal ranks) over symbols, as a transducer.

    Each token is made by one merge, and by none that comes after one that uses it; other lists are refused."""

    def __init__(self, merges: Iterable[tuple[str, str]], suffix: str = ""):
        self.suffix = suffix
        self.rank: dict[tuple[str, str], int] = {}
        #: Rank at which a token is made, and its two parts.
        self.made: dict[str, tuple[int, str, str]] = {}
        used: set[str] = set()
        length: dict[str, int] = {}
        for k, (a, b) in enumerate(merges):
            if (a, b) in self.rank:
                continue
            used |= {a, b}
            if a + b in used:
                raise ValueError(f"{a + b!r} is used before merge {k} makes it")
            if a + b in self.made:
                raise ValueError(f"{a + b!r} is made twice")
            self.rank[a, b] = k
            self.made[a + b] = (k, a, b)
            length[a + b] = length.get(a, 1) + length.get(b, 1)
        #: Tokens that their own symbols tokenize to.
        self.whole: set[str] = set()
        for t, (k, a, b) in self.made.items():
            if (a in self.whole or a not in self.made) and (b in self.whole or b not in self.made) and self.apart(a, b, k):
                self.whole.add(t)
        self._beside: dict[tuple[str, str], bool] = {}
        #: Sufficient lookahead: no token has more symbols.
        self.lookahead = max((length[t] for t in self.whole), default=1)

    def apart(self, a: str, b: str, until: int = NONE) -> bool:
        """Whether no merge of a rank below ``until`` crosses the border of two tokens beside each other.

        Goes back in time: the pieces at the border are the tokens, then what they were made of, the later made first.
        Of merges of equal rank the left one is first, so the right token is the later one."""
        rank, made = self.rank.get, self.made.get
        left = right = until  # the ranks at which the pieces grow on
        ma, mb = made(a), made(b)
        while True:
            r = rank((a, b))
            if r is not None and r < left and r <= right and r < until:
                return False
            if mb is not None and (ma is None or mb[0] >= ma[0]):
                right, b = mb[0], mb[1]
                mb = made(b)
            elif ma is not None:
                left, a = ma[0], ma[2]
                ma = made(a)
            else:
                return True

    def _last(self, text: str, last: list[str], before: str, end: int, suffix: str = "") -> str:
        """The last token of the tokenization up to ``end`` of the window, found when first asked for."""
        whole, known = self.whole, self._beside
        for start in range(end - self.lookahead if end > self.lookahead else 0, end):
            token = text[start:end] + suffix
            if token in whole or start == end - 1:
                previous = (last[start] or self._last(text, last, before, start)) if start else before
                if not previous:
                    break
                pair = previous, token
                beside = known.get(pair)
                if beside is None:
                    if len(known) == PAIRS:
                        known.clear()
                    beside = known[pair] = self.apart(previous, token)
                if beside:
                    break
        else:
            raise AssertionError("some token ends at every place")
        last[end] = token
        return token

    def _closing(self, text: str, last: list[str], before: str) -> list[str]:
        """The tokens of a window that ends with its pre-token."""
        token = self._last(text, last, before, len(text), self.suffix)
        return [*self._back(last, len(text) + len(self.suffix) - len(token)), token]

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of a pre-token of any length, each as soon as it is stable. Positions that no token of the result
        needs are not looked at where the pre-token ends inside the first window."""
        reader, size = iter(symbols), 4 * self.lookahead
        text, before = "", ""  # the window, and the token emitted last
        last = [""]  # the last token of what ends at each place in the window, once known
        while True:
            more = "".join(islice(reader, size + 1 - len(text)))
            text += more
            last += [""] * len(more)
            if len(text) <= size:
                break
            for end in range(1, len(text)):  # the symbol held back may be the last one, which has the suffix
                if not last[end]:
                    self._last(text, last, before, end)
            stable = self._stable(last, len(text) - 1)
            if stable:
                yield from self._back(last, stable)
                before, text, last = last[stable], text[stable:], ["", *last[stable + 1 :]]
            else:
                size *= 2
        if text:
            yield from self._closing(text, last, before)

    def tokens(self, symbols: str) -> Iterable[str]:
        """Tokens of a pre-token: at once where the first window holds all of it."""
        if len(symbols) > 4 * self.lookahead:
            return self.stream(symbols)
        return self._closing(symbols, [""] * (len(symbols) + 1), "") if symbols else []

    def _stable(self, last: list[str], end: int) -> int:
        """The furthest place where the prefixes that end at the L places up to ``end`` all have a border."""
        ends = set(range(end - self.lookahead + 1, end + 1))
        while len(ends) > 1:
            end = max(ends)
            ends.remove(end)
            ends.add(end - len(last[end]))
        return ends.pop()

    @staticmethod
    def _back(last: list[str], end: int) -> list[str]:
        """The tokens up to ``end``."""
        found = []
        while end:
            found.append(last[end])
            end -= len(last[end])
        return found[::-1]


class Encoder:
    """Text to token ids by a vocabulary file in the tokenizers JSON layout, over byte letters."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        spec = json.loads(definition)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.merges = MergeList(merges, model.get("end_of_word_suffix") or "")
        library = Tokenizer.from_str(definition)
        self._normalizer, self._splitter = library.normalizer, library.pre_tokenizer
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._letters = dict(enumerate(byte_letters()))
        self._cache: dict[str | bytes, bytes] = {}
        self._before: dict[str | bytes, bytes] = {}
        self._held = 0
        self._words = self._few = regex.compile(WORD_SPLIT).findall
        self._other: Callable | None = None
        self._other = self._disagreeing(spec)
        if self._other is not None:  # the same split, spelled out for the characters that agree
            same = [c for c in map(chr, range(FAST_BELOW)) if not self._other(c)]
            letters, digits, spaces = ("".join(re.escape(c) for c in same if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}", r"\s"))
            marks = WORD_SPLIT.split("[", 1)[0]
            self._few = re.compile(f"{marks}[{letters}]+|[{digits}]|[^{spaces}{letters}{digits}]+").findall

    def _disagreeing(self, spec: dict) -> Callable | None:
        """Finds a character for which Python's tables do not, or may not, do what the library's do."""
        steps = (spec.get("normalizer") or {}).get("normalizers", [])
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        known = [n["type"] for n in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
        known = known and [n["type"] for n in split] == ["Split", "ByteLevel"] and split[0]["pattern"] == {"Regex": WORD_SPLIT}
        known = known and split[0]["behavior"] == "Removed" and split[0]["invert"] and not split[1]["add_prefix_space"] and not split[1]["use_regex"]
        if not known:
            return None
        same = []
        for c in map(chr, range(FAST_BELOW)):
            if unicodedata.category(c) != "Cn" and all(self._in_python(t) == self._in_library(t) for t in (c, f"a{c}b", f"1{c}.")):
                same.append(re.escape(c))
        return re.compile("[^" + "".join(same) + "]").search

    def _split(self, text: str) -> list[str]:
        """Words of a text of agreeing characters. White space is never in a word, so it need not be replaced."""
        text = self.normalize(text)
        return self._words(text) if self._other is None or self._other(text) else self._few(text)

    def _in_python(self, text: str) -> list[str]:
        return [self._symbols(w) for w in self._split(text)]

    def _in_library(self, text: str) -> list[str]:
        if self._normalizer is not None:
            text = self._normalizer.normalize_str(text)
        return [p for p, _ in self._splitter.pre_tokenize_str(text)]

    def normalize(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _symbols(self, word: str) -> str:
        if word.isascii() and word.isprintable():
            return word
        return word.encode().decode("latin-1").translate(self._letters)

    def _learn(self, word: str | bytes, symbols: str | None = None) -> bytes:
        ids = self._before.get(word)
        if ids is None:
            vocab = self.vocab
            found = self.merges.tokens(self._symbols(word) if symbols is None else symbols)
            ids = array("I", [vocab[t] for t in found if t in vocab]).tobytes()
        if len(word) <= 64:
            if self._held > CACHE_BYTES // 2:
                self._before, self._held = self._cache.copy(), 0
                self._cache.clear()
            self._cache[word] = ids
            self._held += 2 * len(word) + len(ids) + 180  # both objects and their place in the table
        return ids

    def _plain(self, text: str) -> Iterator[bytes]:
        """Ids of a text without added tokens, block by block. A block ends before a space, where neither the
        normalizer nor the splitter looks across."""
        at, known, learn = 0, self._cache.get, self._learn
        while at < len(text):
            upto = len(text)
            if upto - at > BLOCK and (cut := text.find(" ", at + BLOCK)) >= 0:
                upto = cut
            block = text[at:upto]
            if self._other is not None and not self._other(block):
                yield b"".join([known(word) or learn(word) for word in self._split(block)])
            else:  # bytes as keys, as words are strings
                yield b"".join([known(p.encode()) or learn(p.encode(), p) for p in self._in_library(block)])
            at = upto

    def stream(self, text: str) -> Iterator[bytes]:
        """Token ids of a text, as little-endian 32-bit integers, in pieces."""
        for k, part in enumerate(self._added.split(text) if self._added else [text]):
            if k % 2:
                yield array("I", [self.added[part]]).tobytes()
            elif part:
                yield from self._plain(part)

    def encode(self, text: str) -> list[int]:
        ids = array("I")
        ids.frombytes(b"".join(self.stream(text)))
        return ids.tolist()


class Decoder:
    """Token ids to text, one at a time. With ``joined``, pieces as they stand in the vocabulary with a space between
    (what the library gives for a vocabulary without a decoder); otherwise the bytes that the pieces stand for, with a
    space after a word end."""

    def __init__(self, vocab: dict[str, int], added: dict[str, int], suffix: str, joined: bool = True):
        back = {c: bytes([b]) for b, c in enumerate(byte_letters())}
        self.pieces: dict[int, bytes] = {}
        for t, i in vocab.items():
            if joined:
                self.pieces[i] = t.encode()
            else:
                end = bool(suffix) and t.endswith(suffix)
                self.pieces[i] = b"".join(back[c] for c in t.removesuffix(suffix)) + b" " * end
        self.pieces |= {i: t.encode() for t, i in added.items()}
        self.between = b" " if joined else b""
        self.reset()

    def reset(self) -> None:
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")
        self._any = False

    def feed(self, ids: Sequence[int]) -> str:
        """The text that is complete after these ids."""
        pieces = self.pieces
        try:
            new = self.between.join(list(map(pieces.__getitem__, ids)))
        except KeyError:
            new = self.between.join([pieces[i] for i in ids if i in pieces])
        if not new:
            return ""
        lead, self._any = (self.between if self._any else b""), True
        return self._machine.decode(lead + new)

    def end(self) -> str:
        text = self._machine.decode(b"", True)
        self.reset()
        return text


def loaded(definition: str) -> Encoder:
    """The encoder of a definition, built once in each Python worker."""
    return kept(("bpe", len(definition), hash(definition)), lambda: Encoder(definition))


def read_definition(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _run(docs: DataFrame, id_column: str, text_column: str, path: str, schema: str, row: Callable) -> DataFrame:
    spec = docs.sparkSession.sparkContext.broadcast(read_definition(path))  # one vocabulary file

    def start():
        encoder = loaded(spec.value)
        decoder = Decoder(encoder.vocab, encoder.added, encoder.merges.suffix)
        return lambda doc_id, text: [(doc_id, *row(encoder, decoder, text or ""))]

    return map_rows(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")), schema, start, 64)


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids (array of int), n_tokens of every row; null text has no tokens."""

    def row(encoder: Encoder, _: Decoder, text: str) -> tuple:
        ids = encoder.encode(text)
        return ids, len(ids)

    return _run(docs, id_column, text_column, path, "doc_id long, ids array<int>, n_tokens long", row)


def decode(rows: DataFrame, path: str, ids_column: str = "ids", id_column: str = "doc_id", joined: bool = True) -> DataFrame:
    """doc_id, text from rows of ids (null: empty); ids outside the vocabulary give nothing."""
    spec = rows.sparkSession.sparkContext.broadcast(read_definition(path))

    def start():
        encoder = loaded(spec.value)
        decoder = Decoder(encoder.vocab, encoder.added, encoder.merges.suffix, joined)
        return lambda doc_id, ids: [(doc_id, decoder.feed(ids or []) + decoder.end())]

    return map_rows(rows.select(F.col(id_column).alias("doc_id"), ids_column), "doc_id long, text string", start, 64)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Encode and decode every text; digests of both, without carrying ids or texts out of the task."""

    def row(encoder: Encoder, decoder: Decoder, text: str) -> tuple:
        raw = b"".join(encoder.stream(text))
        ids = array("I")
        ids.frombytes(raw)
        decoded = decoder.feed(ids) + decoder.end()
        return len(ids), sha256_hex(raw), sha256_hex(decoded.encode())

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _run(docs, "doc_id", "text", path, schema, row)
