"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are emitted.

Each stretch of a text that no vocabulary piece can cross is merged on its own: adjacent symbols
are a linked list, candidate pairs a heap ordered by rank (then by place), and the lowest-ranked
pair that is still valid is joined until none is left.  The count is the initial symbols (a
character outside the vocabulary counts its UTF-8 bytes) minus the merges.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a repeated row is counted again; a
null id stays null; other columns are left behind.  Texts are never cut.  An empty table gives an
empty result.  Counts of stretches are kept in each Python worker in a table of bounded size.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .cluster import own_names, small_batches
from .text import batches, spans_of

SPACE = "▁"
_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


class PairMerger:
    """Counts the tokens of texts under a sentencepiece BPE vocabulary."""

    def __init__(self, model_path: str, remember: int = 400_000) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        self.rank = {model.id_to_piece(i): round(-model.get_score(i)) for i in plain}
        if len({r for p, r in self.rank.items() if p.strip(SPACE)}) < sum(1 for p in self.rank if p.strip(SPACE)):
            raise ValueError("ranks aren't distinct whole numbers")
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            raise ValueError("a piece crosses a space: texts can't be cut there")
        if any("\n" in p[1:] for p in self.rank):
            raise ValueError("a piece crosses a newline: texts can't be cut there")
        self.pairs = {p[i : i + 2] for p in self.rank for i in range(len(p) - 1)}
        self.kept: dict[str, int] = {}
        self.parts: dict[str, int] = {}
        self.remember = remember

    def merged(self, text: str) -> int:
        """Tokens of a stretch of characters that are all in the vocabulary."""
        n, rank, parts = len(text), self.rank.get, list(text)
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        parts.append("")
        shift = n.bit_length()
        place = (1 << shift) - 1
        heap = [r << shift | i for i in range(n - 1) if (r := rank(text[i : i + 2])) is not None]
        heapq.heapify(heap)
        left, pop, push = n, heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            i = top & place
            j = after[i]
            if j >= n or not parts[i] or rank(piece := parts[i] + parts[j]) != top >> shift:
                continue
            parts[i], parts[j] = piece, ""
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(piece + parts[k])) is not None:
                    push(heap, r << shift | i)
            k = before[i]
            if k >= 0 and (r := rank(parts[k] + piece)) is not None:
                push(heap, r << shift | k)
        return left

    def stretch(self, text: str) -> int:
        """Tokens of a stretch, cut once more between characters that no piece holds side by side."""
        pairs, parts, total, cut = self.pairs, self.parts, 0, 0
        for i in range(1, len(text) + 1):
            if i < len(text) and text[i - 1 : i + 1] in pairs:
                continue
            part, cut = text[cut:i], i
            n = parts.get(part)
            if n is None:
                if len(part) > 1 or part in self.rank:
                    n = self.merged(part)
                else:
                    n = len(part.encode())
                if len(parts) >= self.remember:
                    parts.clear()
                parts[part] = n
            total += n
        return total

    def count(self, text: str) -> int:
        if not text:
            return 0
        if SPACE in text or "  " in text or " \n" in text or text[0] == " ":
            return sum(map(self.stretch, _RUNS.findall(SPACE + text.replace(" ", SPACE))))
        kept, total = self.kept, 0
        for piece in text.replace("\n", " \n").split(" "):  # a leading newline leaves "", the prefix alone
            n = kept.get(piece)
            if n is None:
                n = self.stretch(piece if piece[:1] == "\n" else SPACE + piece)
                if len(kept) >= self.remember:
                    kept.clear()
                kept[piece] = n
            total += n
        return total


_mergers: dict[str, PairMerger] = {}


def merger(model_path: str) -> PairMerger:
    if model_path not in _mergers:
        _mergers[model_path] = PairMerger(model_path)
    return _mergers[model_path]


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of `docs`.

    model: a path, or the name of a file of the `public_tokenizers` package on each executor.
    """

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = model
        if "/" not in model:
            import public_tokenizers

            path = public_tokenizers.path(model)
        count = merger(str(path)).count
        for batch in batches(stream):
            text = batch.column(1)
            n = np.fromiter((count(x) if x else 0 for x in text.to_pylist()), np.int64, batch.num_rows)
            _, off = spans_of(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    small_batches(docs.sparkSession)
    return own_names(docs, {"doc_id": "long", "text": "string"}).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
