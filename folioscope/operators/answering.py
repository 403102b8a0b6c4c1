"""Question answering as one plan: rewrite, route, retrieve beside an audit look-up, answer, verify, trace.

Models are functions that make columns (see ``scorers``); the plan is the same whichever are plugged in.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import routing
from ..functions import text as T
from . import retrieval as R
from .joins import looked_up_in_order
from .scorers import context, judged, rewritten, scorer
from .shared import saved

# The sentence of a refusal, the sidecar's threshold, the shapes of a router's and an audit row's fields.
REFUSAL_TEXT = "근거를 찾지 못했습니다."
AUDIT_THRESHOLD = 0.6
RETRY_THRESHOLD = 0.6
ROUTE_SCHEMA = "collections array<string>, qtype string"


@dataclass
class Models:
    """rewrite(question, history), route(question) and answer(question, context) return text columns; rerank is a scorer."""

    rewrite: Callable[[Column, Column], Column] = lambda question, history: question
    route: Callable[[Column], Column] = lambda question: F.lit("{}")
    answer: Callable[[Column, Column], Column] = lambda question, evidence: F.lit("")
    rerank: Callable[..., Column] | None = None
    strict: bool = True


def json_ok(model_output: Column) -> Column:
    """Whether an output holds a JSON object with anything in it."""
    found = T.json_object(model_output)
    return found.isNotNull() & ~F.coalesce(found.rlike(r"^\{\s*\}$"), F.lit(False))


def route_of(model_output: Column, question: Column) -> Column:
    """struct(collections, qtype) from a router's JSON, guarded and ordered."""
    r = F.from_json(T.json_object(model_output), ROUTE_SCHEMA)
    kind = F.coalesce(r["qtype"], F.lit("일반"))
    return F.struct(routing.route(question, r["collections"], kind).alias("collections"), kind.alias("qtype"))


def audit_card(hits: DataFrame) -> DataFrame:
    """Audit hits as cards whose fields are never null."""
    text = ("case_id", "title", "violation", "basis", "standard", "source_url", "fiscal_year")
    return hits.select("qid", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in text), F.coalesce("standard_superseded", F.lit(False)).alias("standard_superseded"), F.coalesce("score", F.lit(0.0)).alias("score"))


def audit_cases(queries: DataFrame, cases: DataFrame, rerank: Callable[..., Column], k: int = 3, per_coll: int = 20) -> DataFrame:
    """(qid, audit_cases): the best cases at or above the threshold, dense candidates only; cases never enter the answer's evidence."""
    near = R.dense_topk(queries, cases.withColumn("collection", F.lit("audit_cases")), per_coll, per_collection=False)
    rows = near.select("qid", "id").join(cases, "id").join(queries, "qid")
    best = R.rerank(rows, rerank(F.col("qtext"), F.col("text"), F.col("qvec"), F.col("vec")), k).where(F.coalesce("score", F.lit(0.0)) >= AUDIT_THRESHOLD)
    return best.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "case_id", "score"))).alias("a")).select(
        "qid", F.transform("a", lambda x: F.struct(x["case_id"].alias("case_id"), x["score"].alias("score"))).alias("audit_cases")
    )


#: What a second attempt is told about its citations.
CITATION_NOTE = "\n\n앞선 답변의 인용 가운데 제시된 근거에서 찾을 수 없는 것: %s. 위에 제시된 근거의 식별자만 대괄호로 인용하여 새로 답변해 주세요."


def split_by(rows: DataFrame, again: Column) -> tuple[DataFrame, DataFrame]:
    """Rows for which `again` is not true, and those for which it is; rows are kept, so that no model is called for a row twice."""
    kept = saved(rows.withColumn("again_", F.coalesce(again, F.lit(False))))
    return kept.where("not again_").drop("again_"), kept.where("again_").drop("again_")


def answered(rows: DataFrame, answer: Callable[[Column, Column], Column], strict: bool = False) -> DataFrame:
    """Adds said to rows with question, refs and evidence (the context of a prompt).

    Unless strict, an answer that cites what was not retrieved, and is no refusal, is asked for once more with a note of the
    invalid citations; whatever is still invalid is stripped. Other answers are not asked for again.
    """
    first = rows.withColumn("said", T.strip(F.coalesce(answer(F.col("question"), F.col("evidence")), F.lit(""))))
    if strict:
        return saved(first)
    fine, wrong = split_by(first, T.needs_citation_retry(F.col("said"), F.col("refs")))
    note = F.format_string(CITATION_NOTE, F.array_join(T.invalid_citations(F.col("said"), F.col("refs")), ", "))
    second = wrong.withColumn("said", T.strip(F.coalesce(answer(F.col("question"), F.concat("evidence", note)), F.lit(""))))
    both = fine.unionByName(second)
    return both.withColumn("said", T.strip_citations(F.col("said"), T.invalid_citations(F.col("said"), F.col("refs"))))


def retrieved_again(asked: DataFrame, retrieve: Callable[[DataFrame], DataFrame], again: Callable[[DataFrame], DataFrame], threshold: float = RETRY_THRESHOLD, passes: int = 1) -> DataFrame:
    """The hits of `asked` by `retrieve`, with those of questions whose first score is low found once more for other words.

    asked: qid, retried (already asked in other words) and whatever retrieve needs; retrieve(asked) gives hits with qid, slot and
    score; again(low) gives the low questions anew. A question is low if it was not retried and its score in the first slot, 0 without
    hits, is below the threshold. Its first hits are dropped, also where the new ones are worse; other questions' hits are not touched.
    Hits and the low questions, which alone are asked again, are saved between passes, so each pass is a plan of its own and a lost
    executor repeats no model's work. After `passes` passes nothing is low. The result has the hits and pass (0: as first asked).
    """
    hits = saved(retrieve(asked))
    done = [hits.withColumn("pass", F.lit(0))]
    for n in range(1, passes + 1):
        first = hits.groupBy("qid").agg(F.min_by("score", "slot").alias("first_score"))
        low = asked.where(~F.coalesce("retried", F.lit(False))).join(first, "qid", "left").where(F.coalesce("first_score", F.lit(0.0)) < threshold).drop("first_score")
        low = saved(low)
        if low.isEmpty():
            break
        asked = saved(again(low).withColumn("retried", F.lit(n == passes)))
        hits = saved(retrieve(asked))
        done = [d.join(low.select("qid"), "qid", "left_anti") for d in done] + [hits.withColumn("pass", F.lit(n))]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def answer_questions(questions: DataFrame, corpus: DataFrame, cases: DataFrame, models: Models, embed: Callable[[Column], Column], k: int = 8, per_coll: int = 12) -> DataFrame:
    """One row per question: rewritten, route, retrieved_refs, retry, audit_cases, has_grounds, answer, used_refs, verified.

    questions: qid, question, history (messages; null on a first turn); corpus: id, collection, coll_pos, lineno, ref_key, doc_no,
    text, vec; cases: id, case_id, text, vec. A question with history is rewritten before it is routed. One without, whose first
    hit scores low, is rewritten then and retrieved for once more over the same route (retry says so); audit cases are those of
    its last wording. The answer is given to the question as asked. Evidence and audit cases are joined, so each question is answered once.
    """
    rerank = models.rerank or scorer("cosine")
    follows = F.size(F.coalesce("history", F.array())) > 0
    q = questions.withColumn("rewritten", F.when(follows, rewritten(models.rewrite(F.col("question"), F.col("history")), F.col("question"))).otherwise(F.col("question")))
    q = saved(q.withColumn("route", route_of(models.route(F.col("rewritten")), F.col("rewritten"))))  # models are called once
    order = q.select("qid", F.posexplode("route.collections").alias("pos", "collection")).withColumn("standards", F.endswith("collection", F.lit("standards")))

    def retrieve(asked: DataFrame) -> DataFrame:
        worded = asked.select("qid", F.col("rewritten").alias("qtext"), embed(F.col("rewritten")).alias("qvec"))
        slots = R.routed_search(worded, corpus.select("id", "collection", "vec", "text"), order.join(asked.select("qid"), "qid", "left_semi"), rerank, k=k, per_coll=per_coll)
        found = slots.join(corpus.select("id", "ref_key", "doc_no", "text", "vec"), "id").join(worded, "qid")
        return found.withColumn("score", rerank(F.col("qtext"), F.col("text"), F.col("qvec"), F.col("vec"))).select("qid", "slot", "id", "collection", "ref_key", "doc_no", "text", "score")

    reworded = []

    def again(low: DataFrame) -> DataFrame:
        other = saved(low.withColumn("rewritten", rewritten(models.rewrite(F.col("question"), F.col("history")), F.col("question"))))
        reworded.append(other)
        return other

    hits = retrieved_again(q.select("qid", "question", "history", "rewritten", (F.col("rewritten") != F.col("question")).alias("retried")), retrieve, again)
    if reworded:
        last = reworded[0].select("qid", F.col("rewritten").alias("reworded_"))
        q = q.join(last, "qid", "left").withColumn("retry", F.col("reworded_").isNotNull()).withColumn("rewritten", F.coalesce("reworded_", "rewritten")).drop("reworded_")
    else:
        q = q.withColumn("retry", F.lit(False))
    asked = q.select("qid", F.col("rewritten").alias("qtext"), embed(F.col("rewritten")).alias("qvec"))
    shown = T.display_id(F.col("ref_key"), F.col("doc_no"), F.col("id").cast("string"))
    got = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("slot", shown.alias("ref"), "collection", "text", "score"))).alias("retrieved"))
    rows = q.join(got, "qid", "left").join(audit_cases(asked, cases, rerank), "qid", "left")
    empty = F.array().cast("array<string>")
    refs = F.coalesce(F.col("retrieved.ref"), empty)
    rows = rows.withColumn("refs", refs).withColumn("evidence", context(refs, F.coalesce(F.col("retrieved.collection"), empty), F.coalesce(F.col("retrieved.text"), empty)))
    rows = answered(rows, models.answer, models.strict)
    gate = F.when(F.size("refs") > 0, T.answer_gate(F.col("said"), F.col("refs"), models.strict, F.lit(REFUSAL_TEXT)))
    rows = rows.withColumn("g", gate).select(
        F.col("qid").alias("rid"), "question", "rewritten", "route", refs.alias("retrieved_refs"), "retry",
        F.coalesce("audit_cases", F.array().cast("array<struct<case_id:string,score:double>>")).alias("audit_cases"), F.coalesce("g.has_grounds", F.lit(False)).alias("has_grounds"),
        F.coalesce("g.text", F.lit(REFUSAL_TEXT)).alias("answer"), F.coalesce("g.used_refs", empty).alias("used_refs"),
    )
    records = corpus.select("coll_pos", "lineno", "ref_key", "doc_no", "text")
    return rows.join(looked_up_in_order(rows, records), "rid", "left").withColumnRenamed("rid", "qid")


GROUNDING = 6000
EVAL = "struct<faithfulness:double,unsupported:array<string>,answer_relevancy:double,relevancy_reason:string,judge_vendor:string,judge_model:string>"


def judge_prompts(question: Column, answer: Column, grounding: Column) -> tuple[Column, Column]:
    """What a judge is shown for faithfulness and for relevancy. The grounding is cut to GROUNDING characters."""
    faithful = F.concat(F.lit("근거:\n"), T.clip(grounding, GROUNDING), F.lit("\n\n답변:\n"), answer)
    return faithful, F.concat(F.lit("질문: "), question, F.lit("\n\n답변:\n"), answer)


def judged_score(output: Column) -> Column:
    """The score in a judge's JSON, held to 0 to 1; null if there is no object, no score or no number in it."""
    return judged(F.get_json_object(T.json_object(output), "$.score").try_cast("double"))


def judge_answers(trace: DataFrame, judge: Callable[[str, Column, int], Column], vendor: str, model: str) -> DataFrame:
    """The trace (seq, question, answer, grounding, eval and more) with eval filled in where it is null.

    judge(kind, prompt, attempt) is a column of outputs for kind "faithfulness" or "relevancy". An output without a usable score
    is asked for once more, then its score is null; if neither score is there, eval stays null.
    """
    faithful, relevant = judge_prompts(*(F.coalesce(c, F.lit("")) for c in ("question", "answer", "grounding")))
    done, rows = split_by(trace, F.col("eval").isNull())
    for kind, prompt in (("faithfulness", faithful), ("relevancy", relevant)):
        rows = rows.withColumn(kind, judge(kind, prompt, 0))
        fine, again = split_by(rows, judged_score(F.col(kind)).isNull())
        rows = fine.unionByName(again.withColumn(kind, judge(kind, prompt, 1)))
    f, r = judged_score(F.col("faithfulness")), judged_score(F.col("relevancy"))
    listed = F.from_json(F.get_json_object(T.json_object(F.col("faithfulness")), "$.unsupported"), "array<string>")
    reason = F.get_json_object(T.json_object(F.col("relevancy")), "$.reason")
    made = F.struct(
        f.alias("faithfulness"), F.when(f.isNotNull(), F.coalesce(listed, F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("unsupported"), r.alias("answer_relevancy"),
        F.when(r.isNotNull(), F.coalesce(reason, F.lit(""))).otherwise("").alias("relevancy_reason"), F.lit(vendor).alias("judge_vendor"), F.lit(model).alias("judge_model"),
    )
    rows = rows.withColumn("eval", F.when(f.isNotNull() | r.isNotNull(), made)).drop("faithfulness", "relevancy")
    return done.unionByName(rows)


def models_of(registry: dict[str, dict[str, str]], node: str, local: str | None = None, vendor: str | None = None, default: str = "default") -> str:
    """The model of a node: the local one if there is one, else that of the vendor's map, else that of the default map.

    registry: vendor to node to model. An unknown vendor is an error, as is a node that its map lacks.
    """
    return local or registry[vendor or default][node]


def next_history(answered: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, history) for the next turn: the old messages, then exactly the question and the answer."""
    both = questions.select("qid", "history").join(answered.select("qid", "question", "answer"), "qid")
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    return both.select("qid", F.concat(F.coalesce("history", F.array().cast("array<struct<role:string,content:string>>")), F.array(message("user", "question"), message("assistant", "answer"))).alias("history"))


def with_retries(call: Callable, waits: tuple[float, ...] = (2, 4, 8, 16), sleep: Callable[[float], None] = time.sleep) -> Callable:
    """An adapter's call, repeated after each wait when it raises; the last error goes on."""

    def run(*a, **b):
        for wait in waits:
            try:
                return call(*a, **b)
            except Exception:  # noqa: BLE001  which errors pass is the vendor's business
                sleep(wait)
        return call(*a, **b)

    return run


def compare_models(judged: DataFrame) -> DataFrame:
    """Per model: n, refusals, mean faithfulness and relevancy over the rest, and whether a judge of its own vendor scored it.

    judged: model, vendor, judge_vendor, answer, faithfulness, relevancy.
    """
    ok = ~T.is_refusal(F.col("answer"))
    return judged.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(~ok).alias("refusals"), F.avg(F.when(ok, F.col("faithfulness"))).alias("faithfulness"), F.avg(F.when(ok, F.col("relevancy"))).alias("relevancy"),
        F.bool_or(F.col("vendor") == F.col("judge_vendor")).alias("own_judge"),
    )


def score_summary(scores: DataFrame, threshold: float) -> DataFrame:
    """Least, median and greatest score of one row per case, and the share that reaches the threshold."""
    return scores.agg(F.count("*").alias("n"), F.min("score").alias("least"), F.percentile("score", 0.5).alias("median"), F.max("score").alias("most"), F.avg((F.col("score") >= threshold).cast("int")).alias("pass_rate"))


def ranked_list(hits: DataFrame, keep: int) -> DataFrame:
    """One line per hit for display: rank, id, and the text's beginning on one line."""
    w = Window.partitionBy("qid").orderBy("rank")
    brief = F.regexp_replace(T.clip(F.col("text"), 120), "\n", " ")
    return hits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= keep).select("qid", "n", T.display_id(F.col("ref_key"), F.col("doc_no"), F.col("id").cast("string")).alias("display_id"), brief.alias("text"))
