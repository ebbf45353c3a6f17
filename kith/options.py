"""Options shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class KnnOptions:
    """How a top-k similarity join is laid out.

    Every number here bounds what one task or the driver may hold; none of them drops rows.
    A seed side beyond ``broadcast_rows`` / ``broadcast_bytes`` takes the partitioned plan.
    """

    metric: str = "cosine"            # cosine | l2
    exclude_self: bool = False        # leave out the pair whose two ids are equal
    plan: str = "auto"                # auto | broadcast | partitioned
    broadcast_rows: int = 4096        # seeds a broadcast may hold
    broadcast_bytes: int = 64 << 20   # bytes of seed vectors a broadcast may hold
    running_rows: int = 4_000_000     # seeds x k one task may keep
    max_pivots: int = 1024            # pivots of the partitioned plan
    seed_block_rows: int = 4096       # seeds in one block
    corpus_block_rows: int = 262_144  # corpus rows streamed past one seed block by one task
    corpus: str = "auto"              # of the partitioned plan: auto (by estimated cost) | moved | in_place
    floor_share: int = 32             # one row in so many is sampled for floors; 0 for no floors
    floor_rows: int = 200_000         # seeds x k from which on floors are worth a sample

    def __post_init__(self):
        if self.metric not in ("cosine", "l2"):
            raise ValueError(f"unknown metric: {self.metric}")
        if self.plan not in ("auto", "broadcast", "partitioned"):
            raise ValueError(f"unknown plan: {self.plan}")
        if self.corpus not in ("auto", "moved", "in_place"):
            raise ValueError(f"unknown way of the corpus: {self.corpus}")

    def seed_rows(self, k: int, limit: int) -> int:
        """Seeds one task may serve when it keeps ``k`` candidates for each."""
        return max(1, min(limit, self.running_rows // max(1, k)))


@dataclass(frozen=True)
class EmbedOptions:
    dim: int = 64
    text_col: str = "row_as_text"
    vector_col: str = "embedding"


@dataclass(frozen=True)
class GraphOptions:
    """How a neighbour graph is built and searched; recall grows with ``degree`` and ``beam``, cost with them and ``expand``."""

    metric: str = "cosine"     # cosine | l2
    degree: int = 16           # neighbours a node keeps
    orders: int = 4            # directions whose orders give the first neighbours
    rounds: int = 8            # rounds of descent at most
    settled: float = 0.01      # rounds end when at most this share of the edges is new
    entry_factor: float = 4.0  # entry nodes, in square roots of the number of nodes
    entry_least: int = 256     # entry nodes at least, so that small graphs are seen whole
    beam: int = 64             # nodes a search keeps for a seed
    expand: int = 16           # nodes of a beam opened in one step
    steps: int = 12            # steps at most
    shard_bytes: int = 48 << 20      # a larger index is several graphs
    broadcast_bytes: int = 64 << 20  # a larger graph is searched by joins
    seed: int = 42             # of the directions

    def __post_init__(self):
        if self.metric not in ("cosine", "l2"):
            raise ValueError(f"unknown metric: {self.metric}")
