"""Words of the lower-casing word BPE and the ids of each, inside one Python worker.

The tokenizer drops white space and never merges across it, so a text's ids are the ids of its blank-separated words in a
row, and a worker remembers what each word gives. A new word is cut by one compiled pattern, as the tokenizer's own
pattern would, and each part goes to the library's merge model. That short way is for words made only of characters up to
U+017F (without U+0130, whose lower case is two characters) and without ``<|``: there NFC changes nothing, lower case is
one to one, and the pattern's classes are the ones listed here. Other words go through the whole library, and texts with
U+001C to U+001F (blank to Python, not to the tokenizer) go there whole, so every way gives what the library gives.
"""

from __future__ import annotations

import gc
import re
import unicodedata

_RANGE = [chr(i) for i in range(0x180) if i != 0x130]
_LETTERS = "".join(re.escape(c) for c in _RANGE if unicodedata.category(c)[0] == "L" and c.lower() == c)
_NUMBERS = "".join(re.escape(c) for c in _RANGE if unicodedata.category(c)[0] == "N")
_BLANK = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0"
_OTHER = re.compile("[^\\x00-\\u012f\\u0131-\\u017f]|<\\|")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANK}{_LETTERS}{_NUMBERS}]+")

_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: The byte alphabet of byte-level BPE: printable bytes stand for themselves, the others for U+0100 onwards.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

#: Words remembered by a worker; the memory is emptied when it is full, so it is bounded whatever the corpus holds.
REMEMBERED = 1_200_000
_tokenizers: dict = {}


def tokenizer(path: str):
    """The library's tokenizer, once per worker, without the library's own threads."""
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


def library_ids(path: str, text: str) -> list[int]:
    return tokenizer(path).encode(text, add_special_tokens=False).ids


def whole_tokens(path: str) -> frozenset:
    """Vocabulary strings that, as words of their own, are proved to be one token, by encoding each once."""
    t = tokenizer(path)
    entries = [w[:-4] for w in t.get_vocab(with_added_tokens=False) if w.endswith("</w>")]
    entries = [w for w in entries if w and not _OTHER.search(w) and _WORD.findall(w.lower()) == [w]]
    return frozenset(w for w, e in zip(entries, t.encode_batch(entries, add_special_tokens=False)) if len(e.ids) == 1)


class WordTable(dict):
    """word -> what ``make`` gives for its ids, filled as words are asked for; ``add`` sums the parts of a word or text.

    ``short`` answers for parts that need no merging, or gives None.
    """

    def __init__(self, path: str, make, add, short=lambda part: None):
        super().__init__()
        self.path, self.make, self.add, self.short, self.parts = path, make, add, short, {}
        self.merge = tokenizer(path).model.tokenize
        gc.set_threshold(100_000, 50, 50)  # strings and numbers form no cycles; looking through a full table often is waste

    def part(self, p: str):
        if (value := self.short(p)) is None and (value := self.parts.get(p)) is None:
            mapped = p if p.isascii() and p.isprintable() else "".join(map(_BYTES.__getitem__, p.encode()))
            value = self.parts[p] = self.make([t.id for t in self.merge(mapped)])
        return value

    def __missing__(self, w: str):
        if w.isascii() and w.isalpha():
            value = self.part(w.lower())
        elif _OTHER.search(w):
            value = self.make(library_ids(self.path, w))
        else:
            value = self.add(map(self.part, _WORD.findall(w.lower())))
        self[w] = value
        return value

    def text(self, text: str):
        """The sum of what the text's words give."""
        if any(c in text for c in _SEPARATORS):
            return self.make(library_ids(self.path, text))
        if len(self) > REMEMBERED:
            self.clear()
        if len(self.parts) > REMEMBERED:
            self.parts.clear()
        return self.add(map(self.__getitem__, text.split()))
