"""Exact merge-type piece encoding by backtracking, and decoding, of whole texts.

A sequence of pieces is what merging gives exactly if every pair of neighbours is: so the
encoder walks over the longest dictionary matches, tests each new neighbour by undoing the
merges at the border of the two, shortens the match or steps back where the test fails, and marks positions
that led nowhere in a bitfield. Each position fails at most once, so a text costs linear time.
"""
from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

SPACE = "▁"
#: Tests of neighbours a worker remembers. Results don't depend on it.
REMEMBERED = 50_000
#: Ids of distinct chunks a worker remembers, some 200 bytes each; beyond it the older half is forgotten.
CHUNKS = 500_000
#: Rows handed back at a time; ids and decoded texts of more don't stand in memory together.
ROWS = 256
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encoding with the pieces and scores of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        kinds = {p.type for p in model.pieces}
        if train.model_type != pb.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (
                norm.escape_whitespaces and norm.add_dummy_prefix and train.byte_fallback) or kinds & {USER_DEFINED, UNUSED}:
            raise ValueError("only merge-type models with byte fallback and unchanged input are supported")
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.byte_ids = [next(i for i, p in enumerate(model.pieces) if p.piece == f"<0x{b:02X}>") for b in range(256)]
        self.bos = next(i for i, p in enumerate(model.pieces) if p.type == CONTROL and p.piece == "<s>")
        self.eos = next(i for i, p in enumerate(model.pieces) if p.type == CONTROL and p.piece == "</s>")
        self.width = max(map(len, self.ids))
        self.matcher = ahocorasick.Automaton()
        for piece in self.ids:
            self.matcher.add_word(piece, piece)
        self.matcher.make_automaton()
        # a chunk may end before a space mark unless some piece holds one after another character
        self.splits = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        alone = "".join(c for c in "\n\t\r\x0b\x0c" if not any(c in p for p in self.ids))
        stop = re.escape(alone)
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}{stop}]+|{SPACE}+" + (f"|[{stop}]" if alone else "") if self.splits else "(?s).+")
        # pieces of equal score leave the order of merges to their places, which pairs don't show
        seen: dict[float, str] = {}
        joined = {p: s for p, s in self.scores.items() if len(p) > 1}
        tied = {s for p, s in joined.items() if seen.setdefault(s, p) != p}
        tied_pieces = sorted((p for p, s in joined.items() if s in tied), key=len)
        self.tied: list[str] = []
        for p in tied_pieces:
            if not any(t in p for t in self.tied):
                self.tied.append(p)
        self.joined = joined
        self.packed = {p: np.array([i], "<u4").tobytes() for p, i in self.ids.items()}
        self.fits = functools.lru_cache(REMEMBERED)(self._fits)
        self.options = functools.lru_cache(REMEMBERED)(self._options)
        self.halves = functools.cache(self._halves)
        self.known: dict[str, bytes] = {}

    def merged(self, text: str, score=None) -> list[str]:
        """Merge characters by best score, leftmost first: what the encoding means."""
        part, n, score = list(text), len(text), score or self.scores.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, i + 1, both) for i in range(n - 1) if (s := score(both := part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if not part[j] or after[i] != j or part[i] + part[j] != both or not part[i]:
                continue
            part[i], part[j] = both, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := score(more := both + part[k])) is not None:
                    heapq.heappush(heap, (-s, i, k, more))
            if (h := before[i]) >= 0 and (s := score(more := part[h] + both)) is not None:
                heapq.heappush(heap, (-s, h, i, more))
        return [p for p in part if p]

    def _halves(self, piece: str) -> tuple[str, str, bool] | None:
        """The two pieces merged last into a piece, and whether every merge inside them comes before
        by its score; None if merging does not lead to the piece."""
        get = self.scores.get
        parts = self.merged(piece, lambda s: None if s == piece else get(s))
        if len(parts) != 2:
            return None
        inside = [(self.joined[p], self.halves(p)) for p in parts if len(p) > 1]
        return parts[0], parts[1], all(s > self.joined[piece] and h is not None and h[2] for s, h in inside)

    def _fits(self, left: str, right: str) -> bool:
        """Whether merging ``left + right`` anew gives the two.

        The merges on either side of the border are undone, the latest first; the two don't fit if a
        merge across it would have come before the one just undone. Of equal ones the left comes first.
        """
        halves, joined = self.halves, self.joined.get
        whole = left, right
        for p in whole:
            if len(p) > 1 and ((h := halves(p)) is None or not h[2]):
                return h is not None and self.merged(left + right) == [left, right]
        limit, also, never = -np.inf, False, np.inf
        a, b = joined(left, never), joined(right, never)
        while True:
            across = joined(left + right)
            if across is not None and (across > limit or also and across == limit):
                return False
            if a < b:
                limit, also, left = a, False, halves(left)[1]
                a = joined(left, never)
            elif b < never:
                limit, also, right = b, True, halves(right)[0]
                b = joined(right, never)
            else:
                return True

    def _options(self, last: str, piece: str) -> tuple[tuple[str, int], ...]:
        """The beginnings of ``piece`` that are pieces (a single character always is) and fit
        after ``last``, longest first, with their lengths."""
        begins = [piece[:n] for n in range(len(piece), 1, -1) if piece[:n] in self.ids] + [piece[:1]]
        return tuple((p, len(p)) for p in begins if not last or self.fits(last, p))

    def longest(self, text: str, at: int) -> str:
        """The longest piece that begins at ``at``, or the single character."""
        rest = text[at:at + self.width]
        for n in range(self.matcher.longest_prefix(rest), 1, -1):
            if rest[:n] in self.ids:
                return rest[:n]
        return rest[:1]

    def split(self, text: str) -> list[str]:
        """Pieces of a chunk; characters outside the vocabulary stay single."""
        for t in self.tied:
            if t in text:
                return self.merged(text)
        out = [piece for _, piece in self.matcher.iter_long(text)]
        fit = 0
        if "".join(out) == text:
            fits = self.fits
            fit = next((k for k in range(1, len(out)) if not fits(out[k - 1], out[k])), len(out))
            if fit == len(out):
                return out  # the longest matches in a row already fit, the most frequent case
        # the walk's first steps are the longest matches that fit; their other choices are listed on the way back only
        del out[fit:]
        choices: list[tuple | None] = [None] * fit
        options, longest = self.options, self.longest
        alive = bytearray(b"\1") * (len(text) + 1)
        at, last, n = sum(map(len, out)), out[-1] if out else "", len(text)
        while at < n:
            if len(choices) == len(out):
                choices.append(options(last, longest(text, at)))
            elif choices[-1] is None:
                choices[-1] = options(last, longest(text, at))
            for piece, size in choices[-1]:
                if alive[at + size]:
                    out.append(piece)
                    at += size
                    last = piece
                    break
            else:  # nothing leads on from here; step back and take another piece
                alive[at] = 0
                choices.pop()
                at -= len(out.pop())
                last = out[-1] if out else ""
        return out

    def chunk(self, text: str) -> bytes:
        """Ids of a chunk as little-endian 32-bit integers."""
        packed = self.packed
        out = b"".join([packed[p] if p in packed else np.array([self.byte_ids[b] for b in p.encode()], "<u4").tobytes() for p in self.split(text)])
        if len(text) <= 64:
            if len(self.known) >= CHUNKS:
                for old in list(itertools.islice(self.known, CHUNKS // 2)):
                    del self.known[old]
            self.known[text] = out
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text between begin and end ids; a null text is empty."""
        known = self.known.get
        marked = (" " + text).replace(" ", SPACE) if text else ""
        parts = [known(c) or self.chunk(c) for c in self.chunks.findall(marked)]
        return np.array([self.bos], "<u4").tobytes() + b"".join(parts) + np.array([self.eos], "<u4").tobytes()


@functools.lru_cache(2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


@functools.lru_cache(2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _digests(path: str, full: bool):
    kinds = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if full else "")

    @F.pandas_udf(kinds)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder, decode = _encoder(path), _processor(path).decode
        for texts in (b.iloc[k:k + ROWS] for b in batches for k in range(0, len(b), ROWS)):
            rows = []
            for t in texts:
                raw = encoder.encode(t)
                ids = np.frombuffer(raw, "<u4")
                decoded = decode(ids.tolist())
                more = (ids.astype("int32"), decoded) if full else ()
                rows.append((len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), *more))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if full else [])])

    return run


def encoded(docs: DataFrame, text: str = "text", path: str | None = None, full: bool = False) -> DataFrame:
    """Every column but the text, with token counts and digests; ``full`` adds ids and decoded text.

    A map over rows, no shuffle. A null or empty text has the begin and end ids only and
    decodes to nothing. Repeated rows are encoded each. Columns of the same names are replaced.
    """
    ship_package(docs.sparkSession)
    made = {"n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if full else [])}
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made | {text}]
    return docs.select(*keep, _digests(path or model_path(), full)(F.col(text)).alias("__e")).select(*keep, "__e.*")
