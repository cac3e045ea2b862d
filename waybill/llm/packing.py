"""Texts packed into containers of a fixed number of tokens, whole unless a text alone exceeds the capacity.

Hierarchical residual packing: every task packs its own items best-fit (decreasing) and emits the containers that are
nearly full; the underfull ones become the items of the next round, in which fewer tasks hold them, until one task is
left. A round moves only underfull containers, of which a task passes on at most ``CARRY``, the emptiest; fuller ones
beyond that are emitted as they are. So no task ever holds more than a block of items and what its children carry, and
nothing is shuffled but the residue. Each round is checkpointed, since a lost task must not be packed anew differently.

Best fit is O(1) an item: open containers lie in stacks by free space, a bit set says which stacks aren't empty.
"""

from __future__ import annotations

import base64
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waybill.session import BROADCAST_LIMIT, cut

CAPACITY = 2048
#: A container this full is emitted at once.
NEARLY_FULL = 0.985
#: Items packed at once by a task.
BLOCK = 200_000
#: Underfull containers that a task passes on.
CARRY = 4096
#: Tasks of a round that one task of the next takes over.
FAN_IN = 8

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the public byte-level vocabularies cut texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

BIN = "size int, items array<struct<doc_id: bigint, piece_ix: int, tokens: int>>"


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of every text that isn't null or empty, whole, counted by a byte-level public vocabulary.

    The vocabulary file is read on the driver and broadcast behind a check of its size.
    """
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if len(pickle.dumps(ranks)) > BROADCAST_LIMIT:
        raise ValueError(f"{vocabulary} is no vocabulary of a tokenizer: over {BROADCAST_LIMIT} bytes")
    shared = documents.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(encoding.encode_ordinary(t)) for t in batch["text"]]})

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL AND text <> ''")
    return source.mapInPandas(run, "doc_id long, n_tokens int")


def best_fit(items: list[tuple[int, list]], capacity: int) -> list[tuple[int, list]]:
    """(size, contents) of containers, packed best-fit in order of decreasing size; ties keep their order."""
    stacks: list[list[list]] = [[] for _ in range(capacity + 1)]
    free = 0
    out: list[list] = []
    for size, contents in sorted(items, key=lambda x: -x[0]):
        fitting = free >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            box = stacks[room].pop()
            if not stacks[room]:
                free ^= 1 << room
            box[0] += size
            box[1].extend(contents)
        else:
            room, box = capacity, [size, list(contents)]
            out.append(box)
        room -= size
        stacks[room].append(box)
        free |= 1 << room
    return [(size, contents) for size, contents in out]


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, doc_id, piece_ix, n_pieces, start_token, tokens): every item of (doc_id, n_tokens) in a container.

    An item is whole (one piece) unless it exceeds the capacity; then its pieces are as large as the capacity but for
    the last. Items that are null or not above 0 are left out. Repeated rows are packed as often as they occur, then
    ``doc_id`` tells them no longer apart. Ties are packed in stored order; an empty table gives an empty result.
    Other columns are left out.
    """
    spark = sizes.sparkSession
    cut_up = F.expr(f"transform(sequence(0, cast(ceil(n_tokens / {capacity}) as int) - 1), i -> named_struct('piece_ix', i, 'tokens', cast(least({capacity}, n_tokens - {capacity} * i) as int)))")
    pieces = sizes.select(F.col("doc_id").cast("long").alias("doc_id"), "n_tokens").where("n_tokens > 0").select("doc_id", F.explode(cut_up).alias("p")).select("doc_id", "p.piece_ix", "p.tokens")
    full, open_ = None, pieces.select(F.col("tokens").alias("size"), F.array(F.struct("doc_id", "piece_ix", "tokens")).alias("items"))
    nearly = int(capacity * NEARLY_FULL)

    def round_of(last: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def emit(boxes: list[tuple[int, list]], done: bool) -> Iterator[pd.DataFrame]:
                for at in range(0, len(boxes), 10_000):
                    part = boxes[at : at + 10_000]
                    yield pd.DataFrame({"done": done, "size": [s for s, _ in part], "items": [c for _, c in part]})

            held: list[tuple[int, list]] = []
            for batch in batches:
                held += [(int(s), list(c)) for s, c in zip(batch["size"], batch["items"], strict=True)]
                if len(held) >= BLOCK:
                    boxes = best_fit(held, capacity)
                    yield from emit([b for b in boxes if b[0] >= nearly], True)
                    held = [b for b in boxes if b[0] < nearly]
                    if len(held) > BLOCK // 2:  # items that don't go together: keep the emptiest open
                        held.sort(key=lambda b: b[0])
                        yield from emit(held[CARRY:], True)
                        held = held[:CARRY]
            boxes = sorted(best_fit(held, capacity), key=lambda b: b[0])
            under = [b for b in boxes if b[0] < nearly]
            keep = [] if last else under[:CARRY]
            yield from emit(boxes[len(keep) :], True)
            yield from emit(keep, False)

        return run

    parts = pieces.rdd.getNumPartitions()
    while True:
        packed = cut(open_.mapInPandas(round_of(parts <= 1), f"done boolean, {BIN}"))
        closed = packed.where("done").drop("done")
        full = closed if full is None else full.unionByName(closed)
        if parts <= 1:
            break
        parts = -(-parts // FAN_IN)
        open_ = packed.where("NOT done").drop("done").coalesce(parts)
    first = F.array_min(F.transform("items", lambda x: F.struct(x["doc_id"], x["piece_ix"])))
    name = F.concat_ws("-", first["doc_id"].cast("string"), first["piece_ix"].cast("string"))
    out = full.select(name.alias("container_id"), F.inline("items"))
    counts = sizes.where(F.col("n_tokens") >= capacity).select(F.col("doc_id").cast("long").alias("doc_id"), F.ceil(F.col("n_tokens") / capacity).cast("int").alias("n_pieces"))
    whole = out.where((F.col("piece_ix") == 0) & (F.col("tokens") < capacity)).withColumn("n_pieces", F.lit(1))
    # only texts of at least one full piece need their number of pieces looked up
    split = out.where((F.col("piece_ix") > 0) | (F.col("tokens") == capacity)).join(counts.dropDuplicates(["doc_id"]), "doc_id", "left")
    return whole.unionByName(split).select("container_id", "doc_id", "piece_ix", "n_pieces", (F.col("piece_ix") * capacity).alias("start_token"), "tokens")
