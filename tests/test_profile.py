"""Profile reading, screening and genome labels."""

from __future__ import annotations

import random

import numpy as np
import pytest

from helpers import rows_of
from protomatch.operators.profile import best_hits, best_segments, classify_genomes, screen_profiles
from protomatch.sources import read_profiles


def model_text(name, nodes, compo=True, alphabet=("A", "C", "D")):
    lines = ["HMMER3/f [test]", f"NAME  {name}", f"LENG  {len(nodes)}", "ALPH  amino",
             "HMM          " + "        ".join(alphabet), "            m->m     m->i     m->d"]
    if compo:
        lines.append("  COMPO   1.0  1.0  1.0")
    lines += ["          1.0  1.0  1.0", "          0.1  0.1  *"]
    for i, (match, insert) in enumerate(nodes, 1):
        lines += [f"      {i}   " + "  ".join(match) + f"     {i} x - - -", "          " + "  ".join(insert),
                  "          0.1  0.1  0.1"]
    return "\n".join(lines) + "\n//\n"


def test_profiles_are_read_with_or_without_composition(spark, tmp_path):
    one = model_text("shell", [(("1.5", "2.0", "0.5"), ("1.0", "1.0", "1.0")), (("0.1", "*", "3.0"), ("1.0", "2.0", "1.5"))])
    two = model_text("tubulin", [(("0.25", "1.0", "1.0"), ("1.0", "1.0", "1.0"))], compo=False)
    (tmp_path / "m.hmm").write_bytes((one + two.replace("\n", "\r\n")).encode())
    rows = rows_of(read_profiles(spark, str(tmp_path / "m.hmm")), "profile", "node", "residue", "score")
    assert rows == [
        ("shell", 1, "A", -50000), ("shell", 1, "C", -100000), ("shell", 1, "D", 50000),
        ("shell", 2, "A", 90000), ("shell", 2, "C", -10_000_000), ("shell", 2, "D", -150000),
        ("tubulin", 1, "A", 75000), ("tubulin", 1, "C", 0), ("tubulin", 1, "D", 0),
    ]


def slow_best(seq, table):
    best = 0
    for start in range(-len(table), len(seq)):
        run = 0
        for node, row in enumerate(table):
            p = start + node
            if 0 <= p < len(seq):
                run = max(0, run + int(row.get(seq[p].upper(), 0)))
                best = max(best, run)
    return best


def test_best_segments_match_a_plain_search():
    rng = random.Random(5)
    columns = {c: k + 2 for k, c in enumerate("ACDEΩ")}
    table = np.zeros((9, 7), dtype=np.int64)
    table[:, 2:] = [[rng.randrange(-5, 5) for _ in columns] for _ in range(9)]
    table[:, 0] = -(1 << 40)
    rows = [{c: row[k] for c, k in columns.items()} for row in table]
    # Small letters count as capitals; letters that the model lacks, of any alphabet, score 0.
    seqs = ["".join(rng.choice("ACDEacΩωXß\U0001F600") for _ in range(rng.randrange(0, 30))) for _ in range(40)] + ["", "A"]
    assert best_segments(seqs, (columns, table)).tolist() == [slow_best(s, rows) for s in seqs]


def test_lower_case_residues_and_repeated_proteins(spark):
    emissions = spark.createDataFrame([("m", 1, "A", 5), ("m", 2, "c", 7), ("m", 1, "Ж", 1)], "profile string, node int, residue string, score bigint")
    proteins = spark.createDataFrame([("p", "g1", "acd"), ("p", "g1", "ACD"), ("p", "g2", "x"), ("q", "g1", "AC"), ("r", "g3", None)], "protein_id string, genome_id string, seq string")
    screened = screen_profiles(proteins, emissions)
    assert rows_of(screened, "protein_id", "genome_id", "score") == [("p", "g1", 12), ("p", "g1", 12), ("p", "g2", 0), ("q", "g1", 12), ("r", "g3", 0)]
    assert rows_of(best_hits(screened), "genome_id", "protein_id", "score") == [("g1", "p", 12), ("g2", "p", 0), ("g3", "r", 0)]
    assert rows_of(screen_profiles(proteins, emissions, min_score=12), "protein_id") == [("p",), ("p",), ("q",)]
    # One scan of the proteins, and no join to find their genomes.
    plan = best_hits(screened)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def emission_rows(spark, nodes=3):
    rows = [(p, n + 1, r, 10 if r == "ACD"[(n + shift) % 3] else -5)
            for p, shift in (("shell", 0), ("tubulin", 1)) for n in range(nodes) for r in "ACD"]
    return spark.createDataFrame(rows, "profile string, node int, residue string, score bigint")


@pytest.mark.parametrize("nodes_per_pass", [100, 3, 1])
def test_passes_give_the_same_screen(spark, nodes_per_pass):
    proteins = spark.createDataFrame([("a", "XACDX"), ("b", "CDA"), ("c", ""), ("d", None)], "protein_id string, seq string")
    rows = rows_of(screen_profiles(proteins, emission_rows(spark), nodes_per_pass), "protein_id", "profile", "score")
    assert rows == [("a", "shell", 30), ("a", "tubulin", 20), ("b", "shell", 20), ("b", "tubulin", 30),
                    ("c", "shell", 0), ("c", "tubulin", 0), ("d", "shell", 0), ("d", "tubulin", 0)]


def test_genomes_need_every_profile(spark):
    proteins = spark.createDataFrame([("a", 1, "ACD"), ("b", 1, "CDA"), ("b2", 1, "CDA"), ("c", 2, "ACD"), ("d", 3, "")],
                                     "protein_id string, genome_id int, seq string")
    hits = best_hits(screen_profiles(proteins, emission_rows(spark)), proteins)
    genomes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "genome_id int")
    labels = classify_genomes(genomes, hits, {"shell": 30, "tubulin": 30})
    assert rows_of(labels, "genome_id", "shell_id", "tubulin_id", "nucleoid_forming") == [
        (1, "a", "b", "NF"), (2, "c", "c", "nonNF"), (3, "d", "d", "nonNF"), (4, None, None, "nonNF")]
