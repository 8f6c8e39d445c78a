"""Token ids of whole texts, each distinct stretch of a text encoded once per worker.

A byte-level vocabulary cuts a text before it merges, and always between a character
that is not white space and a single space or line feed after it.  Stretches between
such places therefore encode on their own to what they give inside the text, so a
worker keeps the ids of stretches it has met.  A text with other white space, runs of
it, or characters not known to be visible, is encoded whole; so is one that holds the name
of an added token, which the library finds before it cuts.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable

import numpy as np

#: Bytes of stretches and ids a worker remembers; further ones are encoded anew.
REMEMBERED = 64 << 20
#: What a remembered stretch takes beside its own bytes and its ids'.
ENTRY = 200
#: New stretches encoded as one text.
TOGETHER = 2_000
#: Marks that make a piece of their own after a letter.
MARKS = ".,;:!?"
#: Where letters of every edition of Unicode end that any library may know.
LETTERS_END = "\u0250"


def stretches(text: str, added: tuple[str, ...] = ()) -> list[str] | None:
    """The text cut before every space and line feed; None if it has other white space or runs
    of it, or one of the ``added`` names."""
    if any(name in text for name in added):
        return None
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return None
    if not text.replace("\n", "").isprintable():
        return None
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


def _byte_alphabet() -> dict[int, str]:
    """The character a byte-level vocabulary writes for each byte: itself if visible, else one past 255."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(others)}


BYTE_ALPHABET = _byte_alphabet()
_known: dict[tuple[str, int], _Loaded] = {}


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Loaded:
    """A vocabulary, bytes of each id, names of added tokens, and what has been met so far."""

    def __init__(self, path: str, remembered: int):
        from tokenizers import Tokenizer

        self.limit = remembered
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, number in vocabulary.items():
            self.n_bytes[number] = len(token)  # the byte alphabet has one character for each byte
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        #: Stretches put together must not make up a name.
        self.cuts = not any(c in name for name in self.added for c in " \n")
        self.memory: dict[str, bytes] = {}
        self.held = 0

    def remember(self, found: dict[str, bytes]) -> None:
        for name, ids in found.items():
            self.held += len(name) + len(ids) + ENTRY
            if self.held > self.limit:
                self.held = self.limit
                return
            self.memory[name] = ids


def _loaded(path: str, remembered: int | None = None) -> _Loaded:
    """Once per worker and size of its memory."""
    key = path, remembered or REMEMBERED
    if key not in _known:
        _known[key] = _Loaded(*key)
    return _known[key]


def encoder(path: str, remembered: int | None = None) -> Callable[[list[str | None]], list[np.ndarray]]:
    """A function from texts to their ids, one uint32 array each; null is empty.

    A worker remembers ``remembered`` bytes of stretches, ``REMEMBERED`` if not told.
    """
    loaded = _loaded(path, remembered)
    tokenizer, n_bytes, memory = loaded.tokenizer, loaded.n_bytes, loaded.memory
    merge = tokenizer.model.tokenize

    def whole(text: str) -> np.ndarray:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def together(names: list[str]) -> dict[str, bytes]:
        """Stretches that begin with white space encode as one text; bytes tell them apart."""
        ids = np.array(tokenizer.encode_batch_fast(["".join(names)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum([len(n.encode()) for n in names])
        cuts = np.searchsorted(np.cumsum(n_bytes[ids]), ends) + 1
        held = ids.tobytes()
        return {
            n: held[a:b]
            for n, a, b in zip(names, [0, *(cuts[:-1] * 4).tolist()], (cuts * 4).tolist(), strict=True)
        }

    def word(text: str) -> bytes | None:
        """The ids of a word of letters, with the space before it: a single piece, ready to be merged."""
        letters = text[1:] if text[:1] == " " else text
        if not letters.isalpha():
            return None
        if not letters.isascii():
            if max(letters) >= LETTERS_END:
                return None
            text = text.encode().decode("latin-1")
        return array("I", [t.id for t in merge(text.translate(BYTE_ALPHABET))]).tobytes()

    def new_stretches(names: set[str]) -> dict[str, bytes]:
        found, inner = {}, []
        for name in names:
            bare, ahead, after = name, b"", b""
            if name[-1:] in marks and "A" <= name[-2:-1] < LETTERS_END and name[-2].isalpha():
                bare, after = name[:-1], marks[name[-1]]
            if bare[:1] == "\n":
                bare, ahead = bare[1:], line_feed
            ids = memory.get(bare) if bare and bare != name else None
            if ids is None:
                ids = word(bare)
            if ids is not None:
                found[name] = ahead + ids + after
            elif not name:
                found[name] = b""
            elif name[0] in " \n":
                inner.append(name)
            else:
                found[name] = whole(name).tobytes()
        for a in range(0, len(inner), TOGETHER):
            found |= together(inner[a : a + TOGETHER])
        return found

    marks = {m: whole(m).tobytes() for m in MARKS}
    line_feed = whole("\n").tobytes()

    def run(texts: list[str | None]) -> list[np.ndarray]:
        cut = [stretches(text, loaded.added) if text and loaded.cuts else None for text in texts]
        flat = [s for parts in cut if parts for s in parts]
        held = list(map(memory.get, flat))
        missing = [i for i, ids in enumerate(held) if ids is None]
        found = new_stretches({flat[i] for i in missing})
        for i in missing:
            held[i] = found[flat[i]]
        loaded.remember(found)
        out, at = [], 0
        for text, parts in zip(texts, cut, strict=True):
            if parts is None:
                out.append(whole(text) if text else np.empty(0, "<u4"))
            else:
                out.append(np.frombuffer(b"".join(held[at : at + len(parts)]), "<u4"))
                at += len(parts)
        return out

    return run
