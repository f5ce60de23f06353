"""Token ids of texts by a public tokenizer file and the ``tokenizers`` library, inside Arrow tasks."""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

#: A tokenizer file, and where its texts may be cut without changing any id: at white space, which it either
#: drops ('word') or ties to the following word as in byte-level vocabularies ('byte').
KNOWN = {"word_bpe_49k.json": "word", "byte_bpe_50k.json": "byte"}

#: Runs of these letters are one pre-token and stay as they are under NFC, if white space, an ASCII mark or the end follows.
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
AFTER = r"(?=[!-/:-@\[-`{-~]|\s|\Z)"
CHUNKS = {"word": re.compile(rf"[{LETTER}]+{AFTER}|\S+"), "byte": re.compile(rf" ?[{LETTER}]+{AFTER}| ?\S+|\s+(?!\S)|\s+")}
#: Characters that ``re`` takes for white space and the tokenizers do not, and the mark of special tokens: such texts are encoded whole.
ODD = re.compile("[\x1c-\x1f]|<\\|")
LETTERS = re.compile(rf" ?[{LETTER}]+\Z")
#: Byte-level vocabularies write each byte as a character: printable ones as themselves, the others as 256, 257, ...
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
AS_CHARACTER = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}
SPELLED = {ord(c): "".join(AS_CHARACTER[b] for b in c.encode()) for c in [" ", *map(chr, range(192, 256))]}
#: Remembered words; beyond that the later half goes, as the words met first are mostly the frequent ones.
MOST_CACHED = 400_000


def as_bytes(ids: list[int], width: int) -> bytes:
    """Little-endian unsigned ids; an id that does not fit raises."""
    return b"".join([i.to_bytes(width, "little") for i in ids])


class Words(dict):
    """Ids of words as bytes, looked up or encoded on first sight."""

    def __init__(self, tokenizer, kind: str, width: int):
        super().__init__()
        self.tokenizer, self.tokenize, self.lower, self.width = tokenizer, tokenizer.model.tokenize, kind == "word", width
        self.id_bytes = [i.to_bytes(width, "little") for i in range(tokenizer.get_vocab_size())]

    def __missing__(self, word: str) -> bytes:
        if LETTERS.match(word):  # one pre-token
            spelled = word.lower() if self.lower else word
            table = self.id_bytes
            out = b"".join([table[t.id] for t in self.tokenize(spelled.translate(SPELLED))])
        else:
            out = as_bytes(self.tokenizer.encode(word, add_special_tokens=False).ids, self.width)
        self[word] = out
        return out


class Encoder:
    """Encodes texts to little-endian unsigned ids of ``width`` bytes, word by word with a bounded cache.

    Both files split texts at white space, and between letters and marks, before merging, so a text's ids are those of its words in a row
    (tested against whole texts). Words are encoded by the library; only their ids are remembered.
    """

    def __init__(self, path: str, width: int = 4):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.width, self.kind = width, KNOWN.get(os.path.basename(path))
        if self.kind:
            self.chunks, self.words = CHUNKS[self.kind], Words(self.tokenizer, self.kind, width)

    def whole(self, text: str) -> bytes:
        return as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids, self.width)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.kind is None or ODD.search(text):
            return self.whole(text)
        if len(self.words) > MOST_CACHED:
            for w in list(self.words)[MOST_CACHED // 2:]:
                del self.words[w]
        return b"".join(map(self.words.__getitem__, self.chunks.findall(text)))


@lru_cache(maxsize=2)
def encoder(path: str, width: int = 4) -> Encoder:
    """One encoder per worker, file and width."""
    return Encoder(path, width)


def largest_id(path: str) -> int:
    """The largest id a tokenizer file gives, added tokens included."""
    return max(encoder(path).tokenizer.get_vocab(with_added_tokens=True).values())


def crc(raw: bytes) -> int:
    return zlib.crc32(raw)
