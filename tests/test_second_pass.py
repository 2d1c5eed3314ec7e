import subprocess
import sys
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from scorers import bad_words, broken, by_name, everything, fleeting, hanging, unmade
from shuffles import shuffled

from textguard.functions import fixed, model
from textguard.operators import fitted, verdict_store
from textguard.operators import second_pass as second
from textguard.plans import flows
from textguard.session import conf_for

TEXTS = ["good", "bad one", "bad one", "down", fixed.MARKER + " bad", "", "bad: " + fixed.MARKER_PREFIX]


@pytest.fixture
def frame(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "id long, t string")


def test_verdict_words(spark):
    words = ["MALICIOUS", " not malicious ", "\x1dmalicious", "SAFE", "", None]
    rows = spark.createDataFrame([(w,) for w in words], "v string").select(model.is_malicious("v"))
    assert [r[0] for r in rows.collect()] == [True, True, True, False, False, False]


def test_each_open_text_is_scored_once(frame):
    rows = second.candidates(frame, "t").collect()
    assert sorted(r.copies for r in rows) == [1, 1, 1, 2]
    prompts = {r.prompt for r in rows}
    assert fixed.PROMPT_HEAD + "bad one" + fixed.PROMPT_TAIL in prompts
    none = second.candidates(frame, "t", enabled=F.lit(False))
    assert none.isEmpty()


def test_a_model_out_of_reach_leaves_the_texts(frame):
    verdicts = second.score(second.candidates(frame, "t"), bad_words, "m1", batch_rows=1, tasks=3)
    status = {r.text_hash: (r.verdict, r.status) for r in verdicts.collect()}
    assert sorted(s for _, s in status.values()) == ["ok", "ok", "ok", "unavailable"]
    rows = sorted(second.apply_verdicts(frame, verdicts, "t").collect())
    assert [r.t for r in rows] == [
        "good", fixed.SEMANTIC_MARKER, fixed.SEMANTIC_MARKER, "down",
        fixed.MARKER + " bad", "", fixed.SEMANTIC_MARKER,
    ]
    assert [r.malicious for r in rows] == [False, True, True, False, False, False, True]


def test_one_text_out_of_reach_leaves_no_other_unanswered(spark):
    rows = [(f"bad {i}",) for i in range(40)] + [("down",)]
    prompts = second.candidates(spark.createDataFrame(rows, "t string").coalesce(1), "t")
    found = [
        sorted(map(tuple, second.score(prompts, bad_words, "m1", batch_rows=n).collect()))
        for n in (1, 7, 64)
    ]
    assert found[0] == found[1] == found[2]
    assert [s for _, _, s in found[0]].count("unavailable") == 1


def test_each_prompt_by_its_own_model(spark):
    rows = [("any:1b", "see any:1b"), ("other", "see any:1b"), (None, "x")]
    frame = spark.createDataFrame(rows, "m string, t string")
    prompts = second.candidates(frame, "t", F.col("m").isNotNull(), "m").withColumnRenamed("m", "model_name")
    found = {r.model_name: r.verdict for r in second.score_by_model(prompts, by_name).collect()}
    assert found == {"any:1b": "MALICIOUS", "other": "SAFE"}


def test_other_errors_are_not_hidden(frame):
    with pytest.raises(Exception, match="ZeroDivisionError"):
        second.score(second.candidates(frame, "t"), broken, "m1")


def test_no_verdicts_at_all(spark, frame):
    none = spark.createDataFrame([], second.VERDICT_SCHEMA)
    rows = sorted(second.apply_verdicts(frame, none, "t").collect())
    assert [r.t for r in rows] == TEXTS


def test_switched_off_rows_stay(frame):
    verdicts = second.score(second.candidates(frame, "t"), bad_words, "m1", batch_rows=1)
    rows = sorted(
        second.apply_verdicts(frame, verdicts, "t", enabled=F.col("id") != 1).collect()
    )
    assert [r.malicious for r in rows][:3] == [False, False, True]


def test_text_flow(frame):
    answer = flows.text_flow(
        frame.withColumn("t", F.concat("t", F.when(F.col("id") == 0, " system override").otherwise(""))),
        "t", make_scorer=everything, model_name="m",
    )
    rows = sorted(answer.collect())
    assert rows[0].t == "good " + fixed.MARKER and rows[5].t == ""
    assert {r.t for r in rows[1:4]} == {fixed.SEMANTIC_MARKER}
    assert [r.threat for r in rows] == [True, True, True, True, True, False, True]


def test_a_call_that_hangs_is_ended(spark):
    rows = [(f"bad {i}",) for i in range(20)] + [("hang",)]
    prompts = second.candidates(spark.createDataFrame(rows, "t string").coalesce(1), "t")
    start = time.perf_counter()
    verdicts = second.score(prompts, hanging, "m1", batch_rows=8, seconds=0.5).collect()
    assert time.perf_counter() - start < 60
    answered = [r.verdict for r in verdicts if r.status == "ok"]
    assert answered == ["MALICIOUS"] * 20 and [r.verdict for r in verdicts if r.status == "unavailable"] == [None]


def test_a_model_that_cannot_be_made(frame):
    verdicts = second.score(second.candidates(frame, "t"), unmade, "m1").collect()
    assert {(r.verdict, r.status) for r in verdicts} == {(None, "unavailable")}


def test_a_scorer_whose_process_ends_fails_the_job(frame):
    with pytest.raises(Exception, match="process ended"):
        second.score(second.candidates(frame, "t"), fleeting, "m1")


@pytest.mark.parametrize("bits", [64, second.SIEVE])
def test_copies_whatever_the_sieve_holds(spark, monkeypatch, bits):
    monkeypatch.setattr(second, "SIEVE", bits)
    texts = [f"t{i}" for i in range(300)] + ["hot"] * 700 + ["twice", "twice", None, ""]
    rows = second.candidates(spark.createDataFrame([(t,) for t in texts], "t string").repartition(5), "t").collect()
    copies = {r.prompt: r.copies for r in rows}
    want = {t: texts.count(t) for t in texts if t}
    assert len(rows) == len(copies) == 302
    assert copies == {fixed.PROMPT_HEAD + t + fixed.PROMPT_TAIL: n for t, n in want.items()}


def test_only_repeated_texts_are_shuffled(spark):
    asked = second.asked(spark.createDataFrame([("a",), ("b",), ("b",)], "t string"), "t")
    plan = second.candidates(asked, "t")._jdf.queryExecution().optimizedPlan().toString()
    texts = [line for line in plan.splitlines() if "Aggregate" in line and " t#" in line]
    assert len(texts) == 1 and "sha2" not in plan  # those that may repeat; hashes are columns


def test_a_second_run_scores_nothing(spark, tmp_path, frame):
    path = str(tmp_path / "store")
    prompts = second.candidates(frame, "t")
    first = verdict_store.score(prompts, everything, "m:1/b", path, "one")
    assert {r.verdict for r in first.collect()} == {"malicious"} and first.count() == 4
    again = verdict_store.score(prompts, broken, "m:1/b", path, "two")  # it would fail if asked
    assert sorted(again.select("text_hash", "verdict").collect()) == sorted(first.select("text_hash", "verdict").collect())
    # Another model or version knows nothing yet, and the same run again doubles nothing.
    assert verdict_store.known(spark, path, "m:1_b", "1").isEmpty()
    assert verdict_store.known(spark, path, "m:1/b", "2").isEmpty()
    verdict_store.score(prompts, everything, "m:1/b", path, "one")
    assert spark.read.parquet(path).count() == 4
    assert verdict_store.known(spark, str(tmp_path / "none"), "m", "1").isEmpty()


def test_what_had_no_answer_is_asked_again(spark, tmp_path, frame):
    path = str(tmp_path / "store")
    prompts = second.candidates(frame, "t")
    first = verdict_store.score(prompts, bad_words, "m1", path, "one")
    assert sorted(r.status for r in first.collect()) == ["ok", "ok", "ok", "unavailable"]
    later = verdict_store.score(prompts, everything, "m1", path, "two").collect()
    assert sorted(r.verdict for r in later) == [" Malicious.\n", " Malicious.\n", "malicious", "safe"]


def test_a_fitted_model(spark, tmp_path):
    rows = [(i, "rob the bank " * 2 if i % 3 == 0 else "pet the cat", int(i % 3 == 0)) for i in range(30)]
    rows += [(40, None, 1), (41, "the", None), (42, "cat cat", 7)]
    frame = spark.createDataFrame(rows, "id long, t string, bad int")
    fitted.fit(frame, "t", "bad").save(str(tmp_path / "model"))
    from pyspark.ml import PipelineModel

    model = PipelineModel.load(str(tmp_path / "model"))
    new = spark.createDataFrame([(1, "rob"), (2, "a CAT"), (3, ""), (4, "BANK cat bank bank")], "id long, t string")
    verdicts = fitted.score(second.asked(new, "t"), model, "t")
    done = second.apply_verdicts(new, verdicts, "t")
    assert [r.malicious for r in sorted(done.collect())] == [True, False, False, True]
    plan = model.transform(new.withColumnRenamed("t", "text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan


def test_flows_need_no_package_on_the_workers():
    """A session that nobody shipped the package to, with the package only on the driver's path."""
    script = """
import sys
sys.path.insert(0, sys.argv[1])
from textguard.session import session
from textguard.plans import flows
from textguard.session import conf_for
from textguard.operators import gating
spark = session("plain", "local[2]", spark__ui__enabled="false", spark__sql__shuffle__partitions="2")
def make(name):
    return lambda prompts: prompts.map(lambda p: "MALICIOUS" if "evil" in p else "SAFE")
rows = spark.createDataFrame([(1, "evil", ["a"]), (2, "good", ["("])], "id int, t string, own array<string>")
assert sorted(r.threat for r in flows.text_flow(rows.drop("own"), "t", make_scorer=make, model_name="m").collect()) == [False, True]
found = {r.id: r.reason for r in gating.sanitize_by_lists(rows, "t", "own", chains=0).collect()}
assert found[1] is None and "does not compile" in found[2], found
"""
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run([sys.executable, "-c", script, root], cwd="/", capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


def test_calls_that_hang_hold_up_no_others():
    from textguard.operators.bounded import Overlapped

    lots = [[((i, j), "hang" if j == 3 else f"bad {i} {j}") for j in range(8)] for i in range(6)]
    model, start = Overlapped(hanging, "m1", 0.5), time.perf_counter()
    try:
        found = [a for lot in lots for a in model.ask(lot)]
        found += model.rest()
    finally:
        model.close()
    took = time.perf_counter() - start
    assert sorted(found) == [((i, j), None if j == 3 else "MALICIOUS") for i in range(6) for j in range(8)]
    assert took < 20  # one after the other they take 27 s


def test_few_texts_of_a_batch_are_python_objects_at_once(spark):
    def counting(name):
        import sys

        held = sys.getallocatedblocks()  # of the worker too, as the process is forked from it
        return lambda prompts: prompts.map(lambda p: str(held))

    def held(n):
        prompts = spark.range(0, n, 1, 1).selectExpr("cast(id as string) text_hash", "concat('text ', id) prompt")
        rows = second.score(prompts, counting, "m").collect()
        assert sorted(int(r.text_hash) for r in rows) == list(range(n))
        return max(int(r.verdict) for r in rows)

    held(300)  # what is imported on the first call
    assert held(9000) - held(300) < 5000


@pytest.mark.parametrize("broadcast", [0, 2, fitted.VOCABULARY])
def test_a_fitted_model_knows_every_word(spark, tmp_path, broadcast):
    from pyspark.ml import PipelineModel

    rows = [(f"the the common word{'abcdefghij'[i % 10] * (i + 1)}", i % 2) for i in range(40)]
    fitted.fit(spark.createDataFrame(rows, "t string, bad int"), "t", "bad", broadcast).save(str(tmp_path / "model"))
    model = PipelineModel.load(str(tmp_path / "model"))
    texts = [r[0] for r in rows] + ["", "unheard", "the"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 2)], "id long, t string")
    asked = second.asked(frame, "t")
    verdicts = fitted.score(asked, model, "t")
    done = {r.id: r.malicious for r in second.apply_verdicts(asked, verdicts, "t").collect()}
    want = [bool(bad) for _, bad in rows] + [False] * 3
    assert [done[i] for i in range(len(done))] == want * 2


@pytest.mark.parametrize("label", [0, 1])
def test_a_model_fitted_on_one_label(spark, label):
    model = fitted.fit(spark.createDataFrame([("a b", label), ("c", label)], "t string, bad int"), "t", "bad")
    rows = model.transform(spark.createDataFrame([(1, "a"), (2, "x y"), (3, "")], "id long, text string"))
    assert sorted(map(tuple, rows.select("id", "prediction").collect())) == [(i, float(label)) for i in (1, 2, 3)]


def test_few_bytes_of_a_batch_are_held_at_once(spark):
    def holding(name):
        import resource
        from pathlib import Path

        pages = int(Path("/proc/self/statm").read_text().split()[1])
        held = pages * resource.getpagesize()  # with what the worker had when the process was forked from it
        return lambda prompts: prompts.map(lambda p: str(held))

    def held(n):
        prompts = spark.range(0, n, 1, 1).selectExpr("cast(id as string) text_hash", "rpad(id, 6000, 'x') prompt")
        rows = second.score(prompts, holding, "m").collect()
        assert sorted(int(r.text_hash) for r in rows) == list(range(n))
        return max(int(r.verdict) for r in rows)

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    held(300)  # what is imported on the first call
    assert held(9000) - held(300) < 16 << 20  # the texts have 54 MB
    assert spark.conf.get(key) == before


def test_processes_of_several_models_hold_few_bytes(spark):
    def holding(name):
        import resource
        from pathlib import Path

        held = int(Path("/proc/self/statm").read_text().split()[1]) * resource.getpagesize()
        return lambda prompts: prompts.map(lambda p: f"{name} {held}")

    def held(n):
        rows = spark.range(0, n, 1, 1).selectExpr("cast(id as string) text_hash", "rpad(id, 6000, 'x') prompt", "id")
        prompts = rows.selectExpr("concat('m', id div 100 % 3) model_name", "text_hash", "prompt")
        found = second.score_by_model(prompts, holding).collect()
        assert sorted(int(r.text_hash) for r in found) == list(range(n))
        assert all(r.model_name == f"m{int(r.text_hash) // 100 % 3}" == r.verdict.split()[0] for r in found)
        return max(int(r.verdict.split()[1]) for r in found)

    held(300)  # what is imported on the first call
    assert held(9000) - held(300) < 16 << 20  # the texts have 54 MB


def test_settings_of_a_job_are_put_back(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    try:
        spark.conf.set(key, "123456")
        with pytest.raises(ZeroDivisionError), conf_for(spark, spark__sql__execution__arrow__maxBytesPerBatch=7):
            assert spark.conf.get(key) == "7"
            1 / 0
        assert spark.conf.get(key) == "123456"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@pytest.mark.parametrize("bits", [64, second.SIEVE])
def test_only_rows_of_condemned_texts_are_shuffled(spark, monkeypatch, bits):
    monkeypatch.setattr(second, "SIEVE", bits)
    texts = [f"t{i}" for i in range(900)] + ["bad"] * 30 + ["", None] * 30 + [fixed.MARKER + " bad"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    asked = second.asked(rows, "t", F.col("id") != 901)  # nobody asks about one of the bad
    verdicts = second.score(second.candidates(asked, "t"), everything, "m").filter(F.col("text_hash") == F.sha2(F.lit("bad"), 256))
    with conf_for(spark, spark__sql__autoBroadcastJoinThreshold=-1):
        judged = second.apply_verdicts(asked, verdicts, "t")
        moved = shuffled(judged)
        assert judged.columns == ["id", "t", "malicious"]
        found = {r.id: (r.t, r.malicious) for r in judged.collect()}
    want = {i: (fixed.SEMANTIC_MARKER, True) if t == "bad" and i != 901 else (t, False) for i, t in enumerate(texts)}
    assert found == want
    # The rows that may be bad, the bad hash, and the sieve's row.
    assert moved < 40 if bits > 64 else moved < len(texts) / 4
