"""Token ids of whole texts, encoded word by word with a bounded memory of words already seen.

The ids are those of the `tokenizers` file that is named (a test compares them). Its merges are
run by tiktoken, which is several times faster on a file whose ids are in the order of merges.
The byte-level pattern never joins a space that precedes a visible character to what is before
it, so a text may be cut there and its parts encoded alone. Spaces before other white space or
at the end stay inside a part.

Added tokens of the file (`<|endoftext|>`) that stand in a text are one id each, as the library
maps them by default; what is between them is encoded on its own. With `added=False` their
strings are ordinary text, as for the library with `encode_special_tokens`.
"""

import json
import re
from array import array

_LOOSE = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r" (?=\S)")
# Words remembered by a worker, and the longest that is.
WORDS, LONGEST = 400_000, 48
# Fixed value: how the byte-level tokenizer cuts a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies spell printable Latin-1 bytes as themselves and the others, in
    order, as the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class _Words(dict):
    def __init__(self, encode):
        super().__init__()
        self._encode = encode

    def __missing__(self, word):
        ids = self._encode(" " + word)
        if len(word) <= LONGEST:
            self[word] = ids
        return ids


class Encoder:
    """Little-endian 32-bit ids of a text, as bytes."""

    def __init__(self, path: str, added: bool = False):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        listed = {t["content"]: t for t in model.get("added_tokens", ()) if t["content"]}
        to_byte = byte_of_character()
        ranks = {bytes(map(to_byte.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if t not in listed}
        # Added tokens are cut out before, so no special token is given.
        encoding = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._encode = lambda text: array("I", encoding.encode_ordinary(text)).tobytes()
        self._words = _Words(self._encode)
        if not added:
            listed = {}
        self._ids = {t: int(x["id"]).to_bytes(4, "little") for t, x in listed.items()}
        # The longest of those that start at a place is taken.
        self._added = re.compile("|".join(map(re.escape, sorted(listed, key=len, reverse=True)))) if listed else None
        # Tokens that take white space along or need word bounds are left to the library.
        self._library = None
        if any(t.get(flag) for t in listed.values() for flag in ("lstrip", "rstrip", "single_word")):
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(path)

    def __call__(self, text: str) -> bytes:
        found = self._added and self._added.search(text)
        if not found:
            return self._plain(text)
        if self._library:
            return array("I", self._library.encode(text, add_special_tokens=False).ids).tobytes()
        out, at = [], 0
        while found:
            out += self._plain(text[at:found.start()]), self._ids[found.group()]
            at = found.end()
            found = self._added.search(text, at)
        return b"".join([*out, self._plain(text[at:])])

    def _plain(self, text: str) -> bytes:
        parts = _CUT.split(text) if _LOOSE.search(text) else text.split(" ")
        if len(self._words) > WORDS:
            self._words.clear()
        return self._encode(parts[0]) + b"".join(map(self._words.__getitem__, parts[1:]))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, added=True)
    return _ENCODERS[path]
