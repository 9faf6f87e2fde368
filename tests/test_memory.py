"""Memory of contexts: steps and a stream against plain Python."""

import math
import random

import pytest
from tidemesh.operators import memory

SEEN = "owner string, context string, clusters int, impact double"


def plain(steps, most, fixed=()):
    """(owner, context) -> (last_seen, hits, importance) after the steps."""
    out, fixed = {}, dict(fixed)
    for now, rows in enumerate(steps, 1):
        last = {}
        for owner, context, clusters, impact in rows:
            if owner is not None and context is not None and context.strip():
                key = (owner, context.strip())
                last[key] = max(last.get(key, (clusters, impact)), (clusters, impact))
        for key, (clusters, impact) in last.items():
            worth = fixed.get(key) or (max(0.1, 0.8 + 0.15 * clusters + 0.1 * impact) if clusters else 1.0)
            out[key] = (now, out.get(key, (0, 0, 0))[1] + 1, worth)
        keep = lambda k: out[k][2] * 2 ** (-(now - out[k][0]) / 40) * (1 + 0.25 * math.log1p(out[k][1]))
        for owner in {k[0] for k in last}:
            mine = sorted((k for k in out if k[0] == owner), key=lambda k: (-keep(k), k[1]))
            for k in [k for n, k in enumerate(mine) if n >= most or keep(k) < 0.05]:
                del out[k]
                fixed.pop(k, None)
    return out


def steps_of(seed, n):
    rng = random.Random(seed)
    return [[(rng.choice("ab"), rng.choice(["x", "y ", "z", "w", "v", "u", " ", None]), rng.choice([0, 1, 5]), rng.uniform(0, 3)) for _ in range(rng.choice([1, 3, 6]))] for _ in range(n)]


def same(rows, want):
    got = {(r.owner, r.context): (r.last_seen, r.hits, r.importance) for r in rows.where("hits > 0").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_steps(spark):
    steps, state = steps_of(1, 4), memory.fresh(spark)
    state = memory.valued(state, spark.createDataFrame([("a", " x ", 7.0), ("b", "z", -1.0), ("b", " ", 1.0)], "owner string, context string, value double"))
    for now, rows in enumerate(steps, 1):
        state, owners = memory.remembered(state, spark.createDataFrame(rows, SEEN), now, most=3)
        assert all(r.active <= 3 for r in owners.collect())
    same(state, plain(steps, 3, {("a", "x"): 7.0, ("b", "z"): 0.01}))
    left = memory.cleared(state, spark.createDataFrame([("a", " x ")], "owner string, context string"))
    assert left.where("owner = 'a' and context = 'x'").isEmpty() and left.where("owner = 'b'").count() == state.where("owner = 'b'").count()


def test_old_contexts_fade(spark):
    state, _ = memory.remembered(memory.fresh(spark), spark.createDataFrame([("a", "old", 1, 0.0)], SEEN), 1)
    # after five half-lives 0.95 / 32 * 1.17 is below the floor, after four it is not
    for now, n in ((161, 2), (201, 1)):
        after, owners = memory.remembered(state, spark.createDataFrame([("a", "new", 1, 0.0)], SEEN), now)
        assert after.count() == n and owners.first().evicted == 2 - n
    other, _ = memory.remembered(state, spark.createDataFrame([("b", "new", 1, 0.0)], SEEN), 500)
    assert other.count() == 2  # an owner that is not seen keeps what it has


def test_a_stream_is_the_steps(spark, tmp_path):
    steps = [s for s in steps_of(2, 3)]
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, SEEN).coalesce(1).write.json(f"file://{tmp_path}/in/{k}", ignoreNullFields=False)
    keeper = memory.Keeper(spark, f"file://{tmp_path}/memory", most=2)
    for k in range(len(steps)):  # one micro-batch a step, in order
        stream = spark.readStream.schema(SEEN).json(f"file://{tmp_path}/in/{k}/part-*")
        query = stream.writeStream.foreachBatch(lambda batch, _, k=k: keeper(batch, k)).option("checkpointLocation", f"file://{tmp_path}/check{k}").trigger(availableNow=True).start()
        query.awaitTermination(120)
    same(keeper.at(len(steps) - 1), plain(steps, 2))
    keeper(spark.createDataFrame(steps[-1], SEEN), len(steps) - 1)  # a batch that is run again changes nothing
    same(keeper.at(len(steps) - 1), plain(steps, 2))
