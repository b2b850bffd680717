import glob
import random

import numpy as np
import pyarrow.parquet as pq

from prismata.llm import decontaminate


def test_index_groups_and_pieces_are_bounded(spark, monkeypatch):
    """Writers and readers hold a row group, and a search a piece of the candidates, however large a task's share of the corpus is."""
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 400)
    turn = random.Random(4)
    line = lambda n: " ".join(turn.choice("abcde") + turn.choice("xyz") for _ in range(n))
    items = [(i, line(turn.choice([1, 2, 5, 20]))) for i in range(30)]
    docs = spark.createDataFrame([(i, f"{line(80)} {turn.choice(items)[1]} {line(9)}") for i in range(40)], "doc_id long, text string").repartition(1)
    index, _ = decontaminate.indexed(docs)
    groups = [g for f in glob.glob(f"{index.written_to.removeprefix('file://')}/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in (m.row_group(i).num_rows for i in range(m.num_row_groups))]
    assert len(groups) >= 10 and max(groups) <= decontaminate.GROUP
    phrases = decontaminate.Phrases([(i, t.encode()) for i, t in items])
    for batch in index.select(*decontaminate.SEARCHED).toArrow().to_batches():
        for i in range(batch.num_rows):
            shard = decontaminate.Shard(batch, i, phrases.hashes)
            whole = [np.concatenate(x) for x in zip(*((live[row], at) for live, _, row, at in shard.rarest(phrases.terms)))]
            parts = list(shard.rarest(phrases.terms, windows=7, candidates=5))
            assert all(len(live) <= 7 and (len(row) <= 5 or len(live) == 1) for live, _, row, _ in parts)
            assert [np.concatenate(x).tolist() for x in zip(*((live[row], at) for live, _, row, at in parts))] == [x.tolist() for x in whole]
