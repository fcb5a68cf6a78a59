"""Token ids of whole texts for a tokenizer that splits texts into words first."""

from __future__ import annotations

import itertools
import re
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
#: Words a worker keeps for all its tasks, those it meets first, and further words it keeps until there are so many.
KEPT, REMEMBERED = 120_000, 360_000
#: Words of texts that are looked up together.
_GROUP = 1 << 17

# The word pattern of the vocabulary file, written out for texts of Latin-1 characters in lower case.
_LETTER, _DIGIT, _SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\\x09-\\x0d\\x20\\x85\\xa0"
_WORDS = re.compile(f"[{_LETTER}]+|[{_DIGIT}]|'s|'t|'re|'ve|'m|'ll|'d|[^{_SPACE}{_LETTER}{_DIGIT}]+")

# The characters that stand for the bytes of a character (GPT-2's byte alphabet); blanks that part words are none of a word's.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE = {b: chr(b) for b in _PRINTED} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(0x100) if b not in _PRINTED)}
_BYTES = {c: "".join(_BYTE[b] for b in chr(c).encode()) for c in range(0x100) if chr(c) != "\n"}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def shared_words(path: str | None = None) -> WordTokens:
    """The words of this worker process."""
    return WordTokens(path)


class WordTokens:
    """Ids of words as little-endian unsigned 32-bit integers, and of texts word by word.

    Latin-1 texts are cut into words here and each word is looked up; the tokenizer's model sees a
    word only once. All other texts go through the tokenizer whole, and so do those with the
    string of a special token, which it gives an id of its own.
    """

    def __init__(self, path: str | None = None):
        self.tokenizer = Tokenizer.from_file(path or vocabulary_path())
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}
        #: Words of ``known`` beyond the first ``KEPT``.
        self.rare: list[str] = []

    def __len__(self) -> int:
        """Words that are kept for all tasks."""
        return len(self.known) - len(self.rare)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Words that are not known yet, by the merges of the vocabulary alone: they are in lower case and cut already."""
        tokenize = self.model.tokenize
        found = [[token.id for token in tokenize(word)] for word in "\n".join(words).translate(_BYTES).split("\n")]
        raw = np.fromiter(itertools.chain.from_iterable(found), "<u4").tobytes()
        cuts = itertools.accumulate((4 * len(x) for x in found), initial=0)
        ids = [raw[a:b] for a, b in itertools.pairwise(cuts)]
        self.rare += words[max(0, KEPT - len(self)) :]
        self.known.update(zip(words, ids, strict=True))

    def forget(self, but: set[str] | frozenset[str] = frozenset()) -> None:
        """Of the words beyond the first ones, only some stay."""
        for word in self.rare:
            if word not in but:
                del self.known[word]
        self.rare = [word for word in self.rare if word in but]

    def _plain(self, text: str) -> str | None:
        """The text in lower case if it can be cut into words here."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        text = text.lower()
        return None if any(x in text for x in self.special) else text

    def ids(self, text: str) -> bytes:
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        out: list[bytes] = []
        group: list[list[str] | bytes] = []
        held = 0
        for i, text in enumerate(texts):
            plain = self._plain(text)
            own = self._whole(text) if plain is None else _WORDS.findall(plain)
            group.append(own)
            held += len(own) if plain is not None else 0
            if held > _GROUP or i + 1 == len(texts):
                asked = set().union(*[x for x in group if isinstance(x, list)])
                new = asked.difference(self.known)
                if len(self.rare) + len(new) > REMEMBERED:  # only what these texts need stays
                    self.forget(asked)
                if new:
                    self._learn(list(new))
                del asked, new
                out += [b"".join(map(self.known.__getitem__, x)) if isinstance(x, list) else x for x in group]
                group, held = [], 0
        return out
