"""Streams give the same rows as batches, one atom per micro-batch."""

from atomflow.operators.machines import MachineProcessor
from atomflow.sources import AtomFiles, GeneratorSource
from atomflow.streaming import Runtime, run_atoms


def test_atoms_arrive_in_order(spark, tmp_path):
    source = AtomFiles(spark, str(tmp_path / "in"), "v bigint")
    for atom in ([1, 2], [3], [4, 5, 6]):
        for v in atom:
            source.submit(v)
        source.fuse()
    source.seal()
    seen, done = [], []
    run_atoms(source.read(), lambda df, n: seen.append(sorted(r.v for r in df.collect())), str(tmp_path / "check"), lambda: done.append(True))
    assert seen == [[1, 2], [3], [4, 5, 6]] and done == [True]


def test_machine_keeps_its_state_between_atoms(spark, tmp_path):
    def even(row, memory):
        memory["n"] += 1
        return "odd", [(row["v"], "even", memory["n"])]

    def odd(row, memory):
        memory["n"] += 1
        return "even", [(row["v"], "odd", memory["n"])]

    source = AtomFiles(spark, str(tmp_path / "in"), "k bigint, v bigint")
    for v in range(3):
        source.submit(0, v)
        source.fuse()
    processor = MachineProcessor({"even": even, "odd": odd}, "even", ["v", "s", "n"], seq="v")
    out = source.read().groupBy("k").transformWithStateInPandas(processor, "v bigint, s string, n bigint", "Append", "None")
    rows = []
    run_atoms(out, lambda df, n: rows.extend(map(tuple, df.collect())), str(tmp_path / "check"))
    assert sorted(rows) == [(0, "even", 1), (1, "odd", 2), (2, "even", 3)]


def test_machine_keeps_its_whole_memory_between_atoms(spark, tmp_path):
    def only(row, memory):
        memory.setdefault("seen", []).append(row["v"])
        memory["last"] = f"{memory.get('last', '')}{row['v']}"
        return "only", [(row["v"], memory["last"], sum(memory["seen"]))]

    source = AtomFiles(spark, str(tmp_path / "in"), "k bigint, v bigint")
    for v in range(1, 4):
        source.submit(0, v)
        source.fuse()
    processor = MachineProcessor({"only": only}, "only", ["v", "s", "n"], seq="v")
    out = source.read().groupBy("k").transformWithStateInPandas(processor, "v bigint, s string, n bigint", "Append", "None")
    rows = []
    run_atoms(out, lambda df, n: rows.extend(map(tuple, df.collect())), str(tmp_path / "check"))
    assert sorted(rows) == [(1, "1", 1), (2, "12", 3), (3, "123", 6)]


def test_generator_gives_one_atom_per_batch(spark, tmp_path):
    source = GeneratorSource(spark, "v int", lambda atom: [(5 * atom + i,) for i in range(5)] if atom < 2 else None)
    seen = []
    runtime = Runtime(spark)
    runtime.launch(source.read(), lambda df, n: seen.append([r.v for r in df.orderBy("v").collect()]), str(tmp_path / "check"))
    runtime.step_until_complete()
    runtime.shutdown()
    assert [s for s in seen if s] == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]]


def test_throttled(spark):
    from atomflow.sources import throttled

    assert throttled(spark, 5).isStreaming
