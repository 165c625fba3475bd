"""Whole-text encoding with the tokenizers library, through a bounded cache of words.

Byte-level and white-space-dropping tokenizers never merge across a plain single space, so the ids of a
text are those of its space-separated pieces in order. A batch is split and its pieces are made distinct by Arrow; only
distinct pieces are looked up, and only those that are new go to the library, many in one call. The ids of known pieces
are kept in two dictionary generations of about CACHE entries each, which changes speed, never ids. Texts or tokenizers
for which that rule doesn't hold, and texts that hold a special token's name, are encoded whole.
"""

from __future__ import annotations

import gc
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries in each of two generations per Python worker, about 200 bytes an entry.
CACHE = 500_000
#: Pieces put into one call of the tokenizer.
LEARN = 2_000

_SINGLE = re.compile(r"(?<=\S) (?=\S)")
_FAR = re.compile("[^\x00-ɏ]")  # beyond these, case and composition may depend on neighbours
#: Letters near enough, but for one whose lower case has a mark that is no letter, and signs that stand by themselves.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_SIGNS = r"""!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"""
_RUN = re.compile(f"[{_LETTERS}]+|[{_SIGNS}]+")
_RUNS = re.compile(f"[{_LETTERS}{_SIGNS}]+")
_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            spec = json.load(f)
        pre, norm = spec.get("pre_tokenizer") or {}, json.dumps(spec.get("normalizer"))
        self.named = [t["content"].lower() for t in spec.get("added_tokens") or []]
        self.mode, mark, between = "whole", lambda token: False, "\n"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and spec.get("normalizer") is None:
            self.mode, mark = "leading", lambda token: token.startswith("Ġ")  # the byte-level sign for a space
        elif pre.get("type") == "Sequence" and "\\\\s+" in norm and "Lowercase" in norm and spec["model"].get("end_of_word_suffix") == "</w>":
            self.mode, mark = "dropped", lambda token: token.endswith("</w>")
            between = "|"
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocab.values()) + 1
        self.edge, self.line = np.zeros(size, bool), np.zeros(size, bool)
        self.edge[[i for token, i in vocab.items() if mark(token)]] = True
        self.line[self.tokenizer.encode(between, add_special_tokens=False).ids] = True
        self.lead = " " if self.mode == "leading" else ""
        self.newline = self._whole(["\n"])[0]
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _many(self, pieces: list[str], lead: str, between: str, mark: np.ndarray, own: bool) -> list[bytes]:
        """Many pieces in one call. `mark` tells the ids that part them: the sign put between them (own), the first of
        each (with a lead) or the last of each. If there are not as many, each piece is encoded by itself."""
        out: list[bytes] = []
        for i in range(0, len(pieces), LEARN):
            some = pieces[i : i + LEARN]
            ids = np.asarray(self.tokenizer.encode_batch_fast([lead + between.join(some)], add_special_tokens=False)[0].ids, "<u4")
            at, data = 4 * np.flatnonzero(mark[ids]), ids.tobytes()
            if own:
                begins, ends = [0, *(at + 4).tolist()], [*at.tolist(), len(data)]
            else:
                cuts = (at[1:] if lead else at[:-1] + 4).tolist()
                begins, ends = [0, *cuts], [*cuts, len(data)]
            out += [data[a:b] for a, b in zip(begins, ends)] if len(at) + own == len(some) else self._whole([lead + p for p in some])
        return out

    def _runs(self, runs: set[str], lead: str, fresh: set[str] = frozenset()) -> dict[str, bytes]:
        """Ids of runs of letters or signs, of which fresh aren't known; those with a lead are kept under their names,
        others after a zero byte and a space, which no piece holds before a letter or sign."""
        tag = "" if lead == self.lead else "\0 "
        known = {r: b for r in runs - fresh if (b := self.new.get(tag + r) or self.old.get(tag + r))}
        words, signs = list(fresh), []
        for r in runs - fresh - known.keys():
            (words if r.isalpha() else signs).append(r)
        if lead or not self.lead:
            known |= zip(words, self._many(words, lead, " ", self.edge, False))
        else:
            known |= zip(words, self._many(words, "", "\n", self.line, True))
        known |= zip(signs, self._whole([lead + r for r in signs]))
        self.new |= known if not tag else {tag + r: b for r, b in known.items()}
        return known

    def _learn(self, pieces: list[str]) -> None:
        """Ids of pieces that are not known. In leading mode a piece stands for itself after one space.

        Runs of near letters and of signs are encoded apart from each other, and never together, so pieces that are made
        of these alone are put together from their runs."""
        fresh = {p for p in pieces if p.isalpha() and p.isascii()}
        first, later, cut, mixed, other = set(), set(), [], [], []
        for p in pieces:
            if p in fresh:
                continue
            if _RUNS.fullmatch(p):
                head, *rest = _RUN.findall(p)
                first.add(head)
                later.update(rest)
                cut.append((p, head, rest))
            elif not self.lead:
                (other if "|" in p else mixed).append(p)
            elif p[0] == "\n":
                if _RUNS.fullmatch(p, 1):
                    later.update(rest := _RUN.findall(p))
                    cut.append((p, None, rest))
                else:
                    self.new[p] = self._whole([p])[0]
            else:
                (other if " " in p or p[0].isspace() or p[-1].isspace() else mixed).append(p)
        if self.lead:
            heads, tails = self._runs(first, " ", fresh), self._runs(later, "")
            heads[None] = self.newline
        else:
            heads = tails = self._runs(first | later, "", fresh)
        self.new |= [(p, b"".join([heads[head], *map(tails.__getitem__, rest)])) for p, head, rest in cut]
        self.new |= zip(mixed, self._many(mixed, " ", " ", self.edge, False) if self.lead else self._many(mixed, "", " | ", self.line, True))
        self.new |= zip(other, self._whole([self.lead + p for p in other]))

    def _known(self, pieces: list[str]) -> list[bytes]:
        got = list(map(self.new.get, pieces))
        places = [k for k, x in enumerate(got) if x is None]
        if places:
            missing = [pieces[k] for k in places]
            found = list(map(self.old.get, missing)) if self.old else [None] * len(missing)
            self.new |= [(p, b) for p, b in zip(missing, found) if b is not None]
            self._learn([p for p, b in zip(missing, found) if b is None])
            for k, p in zip(places, missing):
                got[k] = self.new[p]
        return got

    def _joined(self, parts: pa.Array, check: bool) -> tuple[list[bytes], list[int]]:
        """Ids of texts from those of their pieces. With check, texts that can't be parted at every space get none and
        are listed: those where a space is next to white space or an edge."""
        coded, ends = parts.values.dictionary_encode(), parts.offsets.to_numpy()
        at, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        count, bad = np.diff(ends), []
        if self.lead and check:
            loose = np.fromiter((not p or p[-1].isspace() or p[0].isspace() and (p[0] != "\n" or p[1].isspace()) for p in pieces), bool, len(pieces))
            if loose.any():
                wide = np.logical_or.reduceat(loose[at], ends[:-1])
                bad = np.flatnonzero(wide).tolist()
                at = at[np.repeat(~wide, count)]
                count = np.where(wide, 0, count)
                used = np.zeros(len(pieces), bool)
                used[at] = True
                pieces = [p if u else "" for p, u in zip(pieces, used.tolist())]
        self.new.setdefault("", b"")
        ids = self._known(pieces)
        ends = np.concatenate([[0], np.cumsum(count)])
        if self.lead:  # a text's first piece has no space before it
            places = ends[:-1][count > 0]
            heads, which = np.unique(at[places], return_inverse=True)
            at[places] = len(pieces) + which
            ids += self._whole([pieces[k] for k in heads])
        size = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
        every = np.frombuffer(b"".join(ids), "<u4")
        first = np.cumsum(size) - size
        size = size[at]
        until = np.concatenate([[0], np.cumsum(size)])
        data = every[np.repeat(first[at] - until[:-1], size) + np.arange(until[-1])].tobytes()
        edges = (4 * until[ends]).tolist()
        return [data[a:b] for a, b in zip(edges, edges[1:])], bad

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. No reference cycles are made here, so the collector, which would visit the cache, waits."""
        waits = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if waits:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list = [b""] * len(texts)
        if len(self.new) >= CACHE:
            self.old, self.new = self.new, {}
        split, whole = [], []
        for i, t in enumerate(texts):
            if t:
                (whole if self.mode == "whole" or "<" in t and any(n in t.lower() for n in self.named) else split).append(i)
        for i, ids in zip(whole, self._whole([texts[i] for i in whole])):
            out[i] = ids
        if split:
            # lines are parted too: in leading mode a piece then begins with the newline, which is an id of its own there
            if self.lead:
                parted = [texts[i].replace("\n", " \n") for i in split]
            else:
                parted = [(t if _FAR.search(t) else t.lower()).replace("\n", " ") for t in map(texts.__getitem__, split)]
            got, bad = self._joined(pc.split_pattern(pa.array(parted, pa.large_string()), " "), True)
            for i, ids in zip(split, got):
                out[i] = ids
            if bad:
                lists = pa.array([_SINGLE.split(texts[split[k]]) for k in bad], pa.list_(pa.large_string()))
                for k, ids in zip(bad, self._joined(lists, False)[0]):
                    out[split[k]] = ids
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]


def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
