"""Token ids of whole texts with a ``tokenizers`` file, each distinct unit encoded once.

Both supported pre-tokenizers always cut before a space that a word follows, around a single newline, and between
letters and ASCII punctuation other than the apostrophe. A text is cut at such places only, so the ids of its units, one
after the other, are the ids of the text; what a unit is made of is left to the library. As words repeat, short units are
kept in a dictionary per worker, bounded by its bytes; long ones (numbers, digests, addresses) are encoded where they stand. Units of ASCII letters go to the library's BPE model itself, which is what its
normalizer and pre-tokenizer would hand over; all others go through the whole library. A text with the first characters
of a special token goes to the library whole. Ids are little-endian unsigned 32-bit integers.
"""
from __future__ import annotations

import os
import re
import string
import struct
import unicodedata
from collections.abc import Iterator

KEPT_BYTES = 112 << 20  # memory of the units a worker learnt last (and those of one slice); beyond, they become the older half, and the former older half is forgotten
ENTRY_BYTES = 230       # Python's own share of an entry: a key, a value and their place in the dictionary
LONGEST_KEPT = 32       # characters; longer units seldom come again
SLICE = 1 << 18         # characters worked on at a time
_CUT = re.compile(r"[a-z] (?=[a-z])")  # plain words on both sides: no rule of either pre-tokenizer looks across
_TAIL = frozenset(string.punctuation) - {"'"}
_WORD = re.compile("(\n?)([A-Za-z]+)([%s]*)" % re.escape("".join(sorted(_TAIL - {"<"}))))  # the usual unit, taken apart in one go
_PACK = [struct.Struct(f"<{n}I").pack for n in range(17)]  # ids of a word as bytes; longer lists are packed by their own format
_KEPT: dict[tuple[str, str], UnitEncoder] = {}


def encoder(path: str, spaces: str, kept: int = KEPT_BYTES) -> UnitEncoder:
    """The worker's encoder for a tokenizer file; ``spaces``: "drop" or "prefix" (a space belongs to the next word)."""
    if (path, spaces) not in _KEPT:
        _KEPT[path, spaces] = UnitEncoder(path, spaces)
    _KEPT[path, spaces].kept = kept
    return _KEPT[path, spaces]


class UnitEncoder:
    def __init__(self, path: str, spaces: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content[:2] for t in self.library.get_added_tokens_decoder().values()]
        self.prefix = spaces == "prefix"
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.kept = KEPT_BYTES

    def _units(self, text: str) -> list[str]:
        """Keys of the units: with "prefix", ``w`` stands for a space and w, and a newline and w for w itself."""
        if not self.prefix:
            if text.isascii():  # both letter cases give the same ids
                text = text.lower()
            return text.replace("\n", " ").split(" ")
        padded = f"\n{text}\n"
        lines = text.split("\n")
        if not any(x in padded for x in ("  ", " \n", "\n ", "\n\n")) and not any(x[0].isspace() or x[-1].isspace() for x in lines):
            keys: list[str] = []
            for line in lines:
                words = line.split(" ")
                words[0] = "\n" + words[0]
                keys += words
                keys.append("\n\n")
            return keys[:-1]
        parts = text.split(" ")
        units = [parts[0]]
        for p in parts[1:]:  # of a run of spaces, the last belongs to what follows
            if p:
                units.append(" " + p)
            else:
                units[-1] += " "
        return ["\n" + u for u in units if u]

    def _literal(self, key: str) -> str:
        return key if not self.prefix else key[1:] if key[0] == "\n" else " " + key

    def _ids(self, keys: set[str]) -> dict[str, bytes]:
        """Ids of units not remembered; letters followed by punctuation are the two parts' ids."""
        tokenize, prefix, found, direct, split, older, known = self.library.model.tokenize, self.prefix, {}, [], [], self.older, self.known
        blank, word, pack = "\n" if prefix else "", _WORD.fullmatch, struct.pack
        for key in keys:
            if key in older:
                found[key] = older[key]
                continue
            usual = word(key)
            if usual:
                mark, core, end = usual.groups()
                head, tail = mark + core, blank + end
                if head not in found and head not in known:
                    if head in older:
                        found[head] = older[head]
                    else:
                        ids = [t.id for t in tokenize(core.lower() if not prefix else core if mark else "\u0120" + core)]
                        found[head] = _PACK[len(ids)](*ids) if len(ids) < 17 else pack(f"<{len(ids)}I", *ids)
                if end:
                    split.append((key, head, tail))
                    if tail not in found and not self._recall(tail, found):
                        direct.append(tail)
                continue
            mark = key[:1] if prefix and key[:1] == "\n" else ""
            core = key[len(mark):]
            end = len(core)
            while end and core[end - 1] in _TAIL:
                end -= 1
            if not 0 < end or not core[:end].isalpha() or "<" in core[end:] or not (core.isascii() or unicodedata.normalize("NFC", core[:end].lower()).isalpha()):
                direct.append(key)
                continue
            head, tail = mark + core[:end], ("\n" if prefix else "") + core[end:]
            if head not in found and not self._recall(head, found):
                if head.isascii():
                    seen = core[:end].lower() if not prefix else core[:end] if mark else "\u0120" + core[:end]
                    ids = [t.id for t in tokenize(seen)]
                    found[head] = struct.pack(f"<{len(ids)}I", *ids)
                else:
                    direct.append(head)
            if end < len(core):
                split.append((key, head, tail))
                if tail not in found and not self._recall(tail, found):
                    direct.append(tail)
        direct = list(dict.fromkeys(direct))
        for key, one in zip(direct, self.library.encode_batch([self._literal(k) if k else k for k in direct], add_special_tokens=False)):
            found[key] = struct.pack(f"<{len(one.ids)}I", *one.ids)
        for key, head, tail in split:
            found[key] = (found[head] if head in found else known[head]) + found[tail]
        return found

    def _recall(self, key: str, found: dict[str, bytes]) -> bool:
        held = self.known.get(key) or self.older.get(key)
        if held is not None:
            found[key] = held
        return held is not None

    def _trim(self, found: dict[str, bytes]) -> None:
        """Count what was just learnt, forget long units, and begin a new half when the present one is full."""
        for k in [k for k in found if len(k) > LONGEST_KEPT]:
            del self.known[k], found[k]
        self.held += ENTRY_BYTES * len(found) + 2 * sum(map(len, found)) + sum(map(len, found.values()))
        if self.held > self.kept:
            self.older, self.known, self.held = self.known if self.held <= 2 * self.kept else {}, {}, 0

    def _slices(self, text: str) -> Iterator[str]:
        """Stretches of a long text, cut before a space between plain words, where a unit ends anyway."""
        at = 0
        while len(text) - at > SLICE:
            cut = _CUT.search(text, at + SLICE)
            if not cut:
                break
            yield text[at: cut.start() + 1]
            at = cut.start() + 1
        yield text[at:] if at else text

    def _encode(self, texts: list[str]) -> list[bytes]:
        rows = [self._units(t) for t in texts]
        new = set().union(*rows).difference(self.known)
        found = self._ids(new) if new else {}
        self.known.update(found)
        get = self.known.__getitem__
        out = [b"".join(map(get, units)) for units in rows]
        if found:
            self._trim(found)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, four bytes each; texts are worked on in groups of about ``SLICE`` characters."""
        return list(self._each(texts))

    def _each(self, texts: list[str]) -> Iterator[bytes]:
        group, size = [], 0
        for t in texts:
            special = any(s in t for s in self.special)
            if group and (special or size + len(t) > SLICE):
                yield from self._encode(group)
                group, size = [], 0
            if special:
                ids = self.library.encode(t, add_special_tokens=False).ids
                yield struct.pack(f"<{len(ids)}I", *ids)
            elif len(t) > SLICE:
                yield b"".join(self._encode([part])[0] for part in self._slices(t))
            else:
                group.append(t)
                size += len(t)
        yield from self._encode(group)
