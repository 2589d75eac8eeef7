"""Operator 10: BPE encoding and decoding of whole texts by prefix-sharing trie traversal.

Texts are cut into words as the vocabulary file says (added tokens first, then NFC, lower case
and the split pattern, then bytes as characters). The distinct new words of a batch go into a
trie of symbols, the last of a word with the end-of-word suffix. A depth-first walk gives each
trie node the last token of the encoding of its prefix: the one vocabulary entry that ends
there and whose pair with the last token before it is left as it is by the merges. Entries that end
at a node come from a second trie, of the vocabulary, in which the walk goes along. A prefix
that many words share is so worked out once, and a word's encoding is read off backwards.

Encodings of words are kept in a cache of bounded size in each Python worker (CACHED_WORDS words of
CACHED_LENGTH characters at most; longer ones live as long as their step); a batch of any size and
a text of any length go through it whole. Ids and decoded texts are made in steps of STEP_CHARS
characters.

Defined results: null is taken as the empty text, which has no ids and decodes to the empty
text. Special strings inside a text become their special ids, as the library does by default.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, only, read_table, text_or_empty

CACHED_WORDS = 150_000
CACHED_LENGTH = 64
CACHED_PAIRS = 200_000
#: Steps from place to place in the vocabulary that a worker keeps, some 25 MB.
CACHED_WAYS = 200_000
INNER, END = 0, 1
#: The split pattern of the vocabulary file, and what it takes as white space.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = "\t-\r \x85\xa0  -     　"


def narrow_split(characters: int) -> str:
    """The split pattern with its classes spelled out for texts of the first so many characters."""
    kinds = {"L": "", "N": ""}
    for c in map(chr, range(characters)):
        if (kind := unicodedata.category(c)[0]) in kinds:
            kinds[kind] += c
    return SPLIT.replace(r"\p{L}", kinds["L"]).replace(r"\p{N}", kinds["N"]).replace(r"\s", SPACE)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if it prints, else from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


beyond_latin = re.compile(r"[^\x00-\xff]").search


class WordEncoder:
    def __init__(self, vocabulary_file: str):
        import regex

        with open(vocabulary_file, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: r for r, pair in enumerate(pairs)}
        self.pairs, self.made = pairs, {a + b: r for r, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.by_digits = {str(i): t for i, t in self.names.items()}
        self.start = len(self.names)
        # Is every token made by one merge, after its parts?
        made_before = lambda x, r: self.made[x] < r if x in self.made else len(self._symbols(x)) == 1
        self.in_order = len(self.made) == len(pairs) and all(made_before(a, r) and made_before(b, r) for r, (a, b) in enumerate(pairs))
        # Tokens without and with the suffix, by their symbols, and all their beginnings: the vocabulary as a trie.
        self.tokens: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for t, i in self.vocab.items():
            ends = bool(self.suffix) and t.endswith(self.suffix) and len(t) > len(self.suffix)
            self.tokens[END if ends or not self.suffix else INNER][t[: -len(self.suffix)] if ends else t] = i
        self.begins = {t[:k] for tokens in self.tokens for t in tokens for k in range(len(t) + 1)}
        self.places: dict[str, tuple] = {}
        self.n_ways = 0
        self.split = regex.compile(SPLIT.replace(r"\s", SPACE)).findall
        self.split_ascii = re.compile(narrow_split(0x80)).findall
        self.split_latin = re.compile(narrow_split(0x100)).findall
        chars = byte_characters()
        odd = re.compile(r"[^!-~]").search
        self.as_chars = lambda word: "".join([chars[b] for b in word.encode()]) if odd(word) else word
        self.words: dict[str, str] = {}  # ids joined by a space, for each word
        self.older: dict[str, str] = {}
        self.valid: dict[int, bool] = {}

    # Merging as the rules say it, for two tokens at most.
    def _merged(self, symbols: list[str]) -> list[str]:
        rank, none = self.rank, len(self.rank)
        while len(symbols) > 1:
            r, i = min((rank.get(p, none), i) for i, p in enumerate(zip(symbols, symbols[1:])))
            if r == none:
                break
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    def _symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return [*body[:-1], body[-1] + self.suffix]
        return [*token]

    def _stays(self, left: int, token: int) -> bool:
        """Do the merges leave left and token, side by side, as they are? left is START at a word's start."""
        if (known := self.valid.get(left << 20 | token)) is None:
            both = [self.names[i] for i in (left, token) if i != self.start]
            if self.in_order and left != self.start:
                known = self._stays(self.start, left) and self._stays(self.start, token) and self._apart(*both)
            else:
                known = self._merged([x for t in both for x in self._symbols(t)]) == both
            if len(self.valid) >= CACHED_PAIRS:
                self.valid.clear()
            self.valid[left << 20 | token] = known
        return known

    def _apart(self, a: str, b: str) -> bool:
        """Does no merge ever join two neighbours, each of which is made by merges in order? Goes back through what touched."""
        rank, made, pairs = self.rank.get, self.made.get, self.pairs
        a_goes = b_goes = len(pairs)  # the merges by which a and b go up in something larger
        while True:
            if (r := rank((a, b))) is not None and r < a_goes and r <= b_goes:  # of equal merges the left one comes first
                return False
            a_came, b_came = made(a, -1), made(b, -1)
            if a_came > b_came:
                a_goes, a = a_came, pairs[a_came][1]
            elif b_came >= 0:
                b_goes, b = b_came, pairs[b_came][0]
            else:
                return True

    def _place(self, text: str) -> tuple:
        """What the vocabulary has for words whose prefix ends in text, the longest end that begins a token.

        That is: the places one symbol on (filled as they are met), the tokens that end here without and
        with the suffix as (token, length), longest first, and text.
        """
        if (known := self.places.get(text)) is None:
            ends = [(text[k:], len(text) - k) for k in range(len(text))]
            known = self.places[text] = ({}, *([(t, n) for end, n in ends if (t := tokens.get(end)) is not None] for tokens in self.tokens), text)
        return known

    def _onward(self, place: tuple, c: str) -> tuple:
        """The place after one more symbol."""
        if self.n_ways >= CACHED_WAYS:  # the walk goes on with places of its own
            self.places, self.n_ways = {}, 0
        text = place[3] + c
        while text not in self.begins:
            text = text[1:]
        self.n_ways += 1
        place[0][c] = after = self._place(text)
        return after

    def learn(self, words: Iterable[str]) -> None:
        """Works out the ids of words, all through one trie."""
        trie: dict = {}
        for word in words:
            node = trie
            for c in self.as_chars(word):
                below = node.get(c)
                if below is None:
                    below = node[c] = {}
                node = below
            node[""] = word  # no symbol is empty
        known, stays, out = self.valid.get, self._stays, self.words
        lasts, froms = [self.start], [0]  # by depth, for the path from the root to the current node
        stack = [(0, trie, self._place(""))]
        while stack:
            depth, node, place = stack.pop()
            del lasts[depth or 1 :], froms[depth or 1 :]
            while True:  # down to where the trie ends; branches wait on the stack
                onward, inner, end, _ = place
                word = node.get("")
                if word is not None:
                    for token, n in end:
                        left = lasts[depth - n]
                        if (ok := known(left << 20 | token)) or ok is None and stays(left, token):
                            break
                    else:
                        raise KeyError(f"no token ends {word}")
                    found, at = [token], depth - n
                    while at:
                        found.append(lasts[at])
                        at = froms[at]
                    found.reverse()
                    out[word] = " ".join(map(str, found))
                    if len(node) == 1:
                        break
                if depth:
                    for token, n in inner:
                        left = lasts[depth - n]
                        if (ok := known(left << 20 | token)) or ok is None and stays(left, token):
                            break
                    else:
                        raise KeyError(f"no token ends at {depth}")
                    lasts.append(token)
                    froms.append(depth - n)
                depth += 1
                ways = [(depth, below, onward.get(c) or self._onward(place, c)) for c, below in node.items() if c]
                if not ways:
                    break
                _, node, place = ways.pop()
                if ways:
                    stack += ways

    def cut(self, text: str) -> list[str]:
        """The words of a text; special strings stand for themselves."""
        if text.isascii() and "<|" not in text:
            return self.split_ascii(text.lower())
        out: list[str] = []
        for k, part in enumerate(self.special_cut.split(text)):
            if k % 2:
                out.append(part)
            elif part.isascii():
                out += self.split_ascii(part.lower())
            else:
                # Lower case is taken character by character, so no final sigma.
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                out += (self.split if beyond_latin(part) else self.split_latin)(part)
        return out

    def encode(self, texts: Iterable[str]) -> list[str]:
        """The ids of each text, joined by a space."""
        cut = [self.cut(t) for t in texts]
        new = set().union(*cut).difference(self.words)
        if new and len(self.words) + len(new) > CACHED_WORDS:  # the older words stay for another round
            self.older, self.words = self.words, {}
            new = set().union(*cut)
        for w in new.intersection(self.older):
            self.words[w] = self.older[w]
        self.words.update((w, str(self.special[w])) for w in new.intersection(self.special))
        self.learn(new.difference(self.words))
        get = self.words.__getitem__
        out = [" ".join(map(get, words)) for words in cut]
        for w in new:
            if len(w) > CACHED_LENGTH:
                del self.words[w]
        return out

    def decode(self, ids: str) -> str:
        """Tokens joined by a space: the file names no decoder, and the library then does that."""
        return " ".join(map(self.by_digits.__getitem__, ids.split()))


@lru_cache(maxsize=1)
def _encoder(vocabulary_file: str) -> WordEncoder:
    return WordEncoder(vocabulary_file)


#: Characters of texts whose new words share one trie; also bounds what a step holds besides the batch.
STEP_CHARS = 1 << 20


def _steps(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in lists of some STEP_CHARS characters."""
    step, size = [], 0
    for t in texts:
        step.append(t)
        size += len(t)
        if size >= STEP_CHARS:
            yield step
            step, size = [], 0
    if step:
        yield step


def encoded(text: Column, vocabulary_file: str) -> Column:
    """ids (joined by a space), n_tokens and the decoded text of a string column."""

    @F.pandas_udf("ids string, n_tokens long, decoded string")
    def encode(texts: pd.Series) -> pd.DataFrame:
        only("word_bpe", _encoder.cache_clear)
        encoder = _encoder(vocabulary_file)
        ids = [i for step in _steps([t or "" for t in texts]) for i in encoder.encode(step)]
        return pd.DataFrame({"ids": ids, "n_tokens": [i.count(" ") + bool(i) for i in ids], "decoded": [encoder.decode(i) for i in ids]})

    return encode(text)


def encoded_digests(text: Column, vocabulary_file: str) -> Column:
    """n_tokens and the SHA-256 of ids and of the decoded text, where the texts themselves aren't wanted."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        only("word_bpe", _encoder.cache_clear)
        encoder = _encoder(vocabulary_file)
        out = []
        for step in _steps([t or "" for t in texts]):
            for ids in encoder.encode(step):
                out.append((ids.count(" ") + bool(ids), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(encoder.decode(ids).encode()).hexdigest()))
        return pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest(text)


def with_encoding(docs: DataFrame, vocabulary_file: str, text: str = "text", digests: bool = False, decoded: str = "decoded") -> DataFrame:
    """docs with ids, n_tokens and the decoded text (in a column named by decoded), or with n_tokens and the two digests; such columns are replaced."""
    bounded_batches(docs.sparkSession)
    made = encoded_digests(text_or_empty(text), vocabulary_file) if digests else encoded(text_or_empty(text), vocabulary_file)
    names = dict.fromkeys(("n_tokens", "ids_sha256", "decoded_sha256")) if digests else {"ids": None, "n_tokens": None, decoded: "decoded"}
    own = free_name(docs, "made")
    return docs.withColumn(own, made).withColumns({n: F.col(f"{own}.{of or n}") for n, of in names.items()}).drop(own)


def op10_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_encoding(docs, public_tokenizers.path("word_bpe_49k.json"), digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
