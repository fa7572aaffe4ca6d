"""Fixed relational lookups and summaries over policies, claims and payments, batched over tables of parameters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import text as X
from cairn.sources.scratch import stored

# Fixed values that results depend on.
CLAIM_NUMBER, POLICY_NUMBER = r"^SIN-\d{4}-\d{6}$", r"^AP-(AUTO|RES|EMP)-\d{6}$"
CLAIM_IN_TEXT, POLICY_IN_TEXT = r"(?i)\bSIN-\d{4}-\d{6}\b", r"(?i)\bAP-(?:AUTO|RES|EMP)-\d{6}\b"
CLAIM_WORDS = ("sinistro", "sinistros", "pago", "paga", "pagamento", "indeniza", "reembols", "aviso", "regulacao", "ocorrencia")
PAID_STATUSES, LIST_MOST = ("Pago", "Pago parcial"), 20
QUERIES = ("get_claim", "get_claim_payment", "list_claims_by_policy", "claims_summary", "get_policy", "count_claims")
#: Which payment of a claim comes first. A number need not be unique within its claim: the last two leave no tie that shows.
PAYMENT_ORDER = ("payment_date", "payment_no", "paid_amount", "payment_type")
#: Plans up to this number are few: claims that they do not ask for are left out first.
FEW_PLANS = 1_000_000
CLAIMED = "valor reivindicado pelo segurado, antes da regulação"


def claim_lookup(asked: DataFrame, claims: DataFrame, policies: DataFrame) -> DataFrame:
    """The claims asked for (claim_number) with the product and number of their policy."""
    facts = policies.select("policy_id", "product", "policy_number")
    return claims.join(asked.select("claim_number").distinct(), "claim_number", "left_semi").join(facts, "policy_id")


def claim_payment(asked: DataFrame, claims: DataFrame, policies: DataFrame, payments: DataFrame) -> DataFrame:
    """The same with a payment, null without one. Of several payments the earliest counts (then the lowest number, amount and type)."""
    first = F.min_by(F.struct("paid_amount", "payment_date", "payment_type"), F.struct(*PAYMENT_ORDER)).alias("p")
    found = claim_lookup(asked, claims, policies)
    paid = payments.join(found.select("claim_id").distinct(), "claim_id", "left_semi").groupBy("claim_id").agg(first)
    return found.join(paid, "claim_id", "left").select(*found.columns, "p.paid_amount", "p.payment_date", "p.payment_type")


def claims_of_policies(asked: DataFrame, policies: DataFrame, claims: DataFrame, limit: int = LIST_MOST) -> DataFrame:
    """D3: each asked policy (policy_number) with its newest claims, at most ``limit``; ties by claim_id; none: one row of nulls."""
    if not 1 <= limit <= LIST_MOST:
        raise ValueError(f"limit must be 1 to {LIST_MOST}")
    own = policies.join(asked.select("policy_number").distinct(), "policy_number", "left_semi").select("policy_id", "policy_number")
    rows = claims.join(own.select("policy_id"), "policy_id", "left_semi").select("policy_id", "claim_id", "claim_number", "claim_type", "status", "occurrence_date", "claim_amount")
    order = W.partitionBy("policy_id").orderBy(F.desc("occurrence_date"), "claim_id")
    newest = rows.withColumn("n", F.row_number().over(order).cast("long")).filter(F.col("n") <= limit)
    return own.join(newest, "policy_id", "left")


def having(df: DataFrame, **wanted: object) -> DataFrame:
    """Optional filters: those that are None do not enter the plan. ``*_from`` and ``*_to`` are bounds."""
    for name, value in wanted.items():
        if value is None:
            continue
        if name.endswith("_from"):
            df = df.filter(F.col(name[:-5]) >= F.lit(value))
        elif name.endswith("_to"):
            df = df.filter(F.col(name[:-3]) <= F.lit(value))
        else:
            df = df.filter(F.col(name) == F.lit(value))
    return df


def claims_summary(claims: DataFrame, policies: DataFrame, payments: DataFrame, *, product=None, claim_type=None, payment_type=None, date_from=None, date_to=None) -> DataFrame:
    """Count, sum, average, least and largest of payments."""
    c = having(claims, claim_type=claim_type, occurrence_date_from=date_from, occurrence_date_to=date_to)
    p = having(policies.select("policy_id", "product"), product=product)
    paid = having(payments, payment_type=payment_type).join(c.select("claim_id", "policy_id"), "claim_id").join(p, "policy_id")
    amount = F.col("paid_amount")
    return paid.agg(F.count("*").alias("paid_count"), F.sum(amount).alias("paid_sum"), F.avg(amount).alias("paid_avg"), F.min(amount).alias("paid_min"), F.max(amount).alias("paid_max"))


def policy_lookup(asked: DataFrame, policies: DataFrame) -> DataFrame:
    """The policies asked for (policy_number)."""
    return policies.join(asked.select("policy_number").distinct(), "policy_number", "left_semi")


def count_claims(claims: DataFrame, policies: DataFrame, payments: DataFrame, *, product=None, claim_type=None, status=None, payment_type=None, date_from=None, date_to=None, paid=None) -> DataFrame:
    """Claims, and those with a payment. ``paid`` keeps claims with (True) or without (False) one."""
    if status in PAID_STATUSES:
        raise ValueError("status cannot express paid; use paid or payment_type")
    if paid is False and payment_type is not None:
        raise ValueError("paid=False contradicts payment_type")
    c = having(claims, claim_type=claim_type, status=status, occurrence_date_from=date_from, occurrence_date_to=date_to)
    c = c.join(having(policies, product=product).select("policy_id"), "policy_id", "left_semi")
    if payment_type is not None:
        c = c.join(having(payments, payment_type=payment_type).select("claim_id"), "claim_id", "left_semi")
    if paid is not None:
        c = c.join(payments.select("claim_id"), "claim_id", "left_semi" if paid else "left_anti")
    c = c.join(payments.select("claim_id").distinct().withColumn("has", F.lit(True)), "claim_id", "left")
    return c.agg(F.count("*").alias("claim_count"), F.count("has").alias("paid_claim_count"))


def summaries(claims: DataFrame, policies: DataFrame, payments: DataFrame, asked: DataFrame) -> DataFrame:
    """D4, D6 for every product asked for (product), known or not: paid_count, paid_sum, paid_avg, paid_min, paid_max, claim_count, paid_claim_count.

    Payments are added up by claim and then by product: each table is read once, whatever the number of products.
    """
    amount, of = F.col("paid_amount"), policies.select("policy_id", "product")
    by_claim = payments.groupBy("claim_id").agg(F.count("*").alias("k"), F.sum(amount).alias("s"), F.min(amount).alias("lo"), F.max(amount).alias("hi"))
    rows = claims.join(of.join(asked.select("product").distinct(), "product", "left_semi"), "policy_id").join(by_claim, "claim_id", "left")
    found = rows.groupBy("product").agg(
        F.sum("k").alias("paid_count"), F.sum("s").alias("paid_sum"), F.min("lo").alias("paid_min"), F.max("hi").alias("paid_max"), F.count("*").alias("claim_count"), F.count("k").alias("paid_claim_count"),
    )
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("paid_count", "claim_count", "paid_claim_count")}
    return asked.join(found, "product", "left").withColumns(counts).withColumn("paid_avg", F.when(F.col("paid_count") > 0, F.col("paid_sum") / F.col("paid_count")))


def snapshot_date(claims: DataFrame, payments: DataFrame) -> DataFrame:
    """The latest date that either table knows."""
    d = claims.agg(F.max("occurrence_date").alias("d")).unionAll(payments.agg(F.max("payment_date").alias("d")))
    return d.agg(F.max("d").alias("snapshot_date"))


def validated(plans: DataFrame) -> DataFrame:
    """Plans (query, claim_number, policy_number, status, payment_type, paid, row_limit) with ``rejected``, null if valid."""
    bad = lambda test, text: F.when(F.coalesce(test, F.lit(False)), F.lit(text))
    needs = F.col("query").isin("get_claim", "get_claim_payment")
    policy = F.col("query").isin("get_policy", "list_claims_by_policy")
    return plans.withColumn("rejected", F.coalesce(
        bad(~F.col("query").isin(*QUERIES) | F.col("query").isNull(), "unknown query"),
        bad(needs & ~F.coalesce(F.col("claim_number").rlike(CLAIM_NUMBER), F.lit(False)), "claim_number"),
        bad(policy & ~F.coalesce(F.col("policy_number").rlike(POLICY_NUMBER), F.lit(False)), "policy_number"),
        bad(F.col("status").isin(*PAID_STATUSES), "status cannot express paid"),
        bad((F.col("paid") == F.lit(False)) & F.col("payment_type").isNotNull(), "paid=false contradicts payment_type"),
        bad(~F.col("row_limit").between(1, LIST_MOST), "limit"),
    ))


def claim_text(row: Mapping[str, Column]) -> Column:
    """A claim as text, its amount marked as claimed."""
    line = lambda k: F.concat(F.lit(f"{k}: "), row[k].cast("string"))
    return F.concat_ws(
        "\n", *map(line, ("claim_number", "claim_type", "status", "occurrence_date")), F.concat(F.lit(f"valor_reivindicado ({CLAIMED}): "), X.brl(row["claim_amount"])),
        *map(line, ("product", "policy_number")), F.concat(F.lit('valor pago: consultar claims.get_claim_payment(claim_number="'), row["claim_number"], F.lit('")')),
    )


def payment_text(row: Mapping[str, Column]) -> Column:
    """A payment as text, or that there is none."""
    line = lambda k: F.concat(F.lit(f"{k}: "), row[k].cast("string"))
    head = F.concat_ws("\n", *map(line, ("claim_number", "status", "product")))
    paid = F.concat_ws("\n", head, F.concat(F.lit("paid_amount: "), X.brl(row["paid_amount"])), *map(line, ("payment_date", "payment_type")))
    return F.when(row["paid_amount"].isNull(), F.concat(head, F.lit('\nnenhum pagamento registrado — sinistro em status "'), row["status"], F.lit('"'))).otherwise(paid)


def policy_text(row: Mapping[str, Column]) -> Column:
    """A policy as text; dates and status where the table has them."""
    line = lambda k: F.concat(F.lit(f"{k}: "), row[k].cast("string"))
    return F.concat_ws("\n", *(line(k) for k in ("policy_number", "product", "start_date", "end_date", "status") if k in row), F.concat(F.lit("annual_premium: "), X.brl(row["annual_premium"])))


def listed_text(claims: Column) -> Column:
    """The claims of a policy (structs with n, claim_number, claim_type, status, occurrence_date, claim_amount, paid_amount), in order of n."""
    line = lambda x, k: F.concat(F.lit(f"{k}: "), x[k].cast("string"))
    paid = lambda x: F.coalesce(X.brl(x["paid_amount"]), F.lit("nenhum pagamento"))
    block = lambda x: F.concat_ws("\n", *(line(x, k) for k in ("claim_number", "claim_type", "status", "occurrence_date")), F.concat(F.lit(f"valor_reivindicado ({CLAIMED}): "), X.brl(x["claim_amount"])), F.concat(F.lit("paid_amount: "), paid(x)))
    return F.array_join(F.transform(F.array_sort(claims), block), "\n\n")


def summary_text(row: Mapping[str, Column]) -> Column:
    """A summary of payments (D4) as text, or that there is none."""
    head = F.concat(F.lit("paid_count: "), row["paid_count"].cast("string"))
    sums = (F.concat(F.lit(f"{k}: "), X.brl(row[k])) for k in ("paid_sum", "paid_avg", "paid_min", "paid_max"))
    return F.when(row["paid_count"] > 0, F.concat_ws("\n", head, *sums)).otherwise(F.concat_ws("\n", head, F.lit("nenhum pagamento nas condições filtradas")))


def count_text(row: Mapping[str, Column]) -> Column:
    """A count of claims (D6) as text."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), row[k].cast("string")) for k in ("claim_count", "paid_claim_count")))


def not_found(query: Column, key: Column) -> Column:
    """What stands for the text of a key without a row."""
    head = F.when(query == "get_policy", "apólice não encontrada: ").when(query == "list_claims_by_policy", "nenhum sinistro nesta apólice: ").otherwise("sinistro não encontrado: ")
    return F.concat(head, key)


def guard(evidence: DataFrame, snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence that may pass, and what may not: personal data in its text, or no snapshot date."""
    both = evidence.crossJoin(F.broadcast(snapshot))
    bad = (F.size(X.pii_kinds(F.col("text"))) > 0) | F.col("snapshot_date").isNull()
    return both.filter(~bad), both.filter(bad)


def evidence_rows(found: DataFrame, query: str, params: Mapping[str, Column], snapshot: DataFrame) -> DataFrame:
    """Evidence (id, section, version, effective_date, doc_role, source_kind, product, text) of lookups with a ``text``."""
    rows = found.select(X.evidence_id(F.lit(query), params).alias("evidence_id"), X.call_text(F.lit(query), params).alias("section"), "product", "text")
    fixed = {"document_code": "claims.db", "version": "snapshot", "doc_role": "database", "source_kind": "claims"}
    return rows.crossJoin(F.broadcast(snapshot)).withColumnRenamed("snapshot_date", "effective_date").withColumns({k: F.lit(v) for k, v in fixed.items()})


def route(questions: DataFrame) -> DataFrame:
    """question_id, step, query, key: two plans a claim number, one or two a policy number, each number once, in order.

    The list of a policy's claims is planned if the question names a claim or has a word about claims.
    """
    numbers = lambda p: F.array_distinct(F.transform(F.regexp_extract_all("question", F.lit(p), 0), F.upper))
    q = questions.select("question_id", "question", numbers(CLAIM_IN_TEXT).alias("c"), numbers(POLICY_IN_TEXT).alias("p"))
    plan = lambda name, key: F.struct(F.lit(name).alias("query"), key.alias("key"))
    about = (F.size("c") > 0) | F.coalesce(*(F.when(F.contains(X.fold(F.col("question")), F.lit(w)), F.lit(True)) for w in CLAIM_WORDS), F.lit(False))
    of_claim = F.flatten(F.transform("c", lambda x: F.array(plan("get_claim", x), plan("get_claim_payment", x))))
    both, one = (lambda x: F.array(plan("get_policy", x), plan("list_claims_by_policy", x))), (lambda x: F.array(plan("get_policy", x)))
    of_policy = F.when(about, F.flatten(F.transform("p", both))).otherwise(F.flatten(F.transform("p", one)))
    return q.select("question_id", F.posexplode(F.concat(of_claim, of_policy)).alias("i", "plan")).select("question_id", (F.col("i") + 1).cast("long").alias("step"), "plan.*")


def claim_facts(claims: DataFrame, policies: DataFrame, payments: DataFrame | None) -> DataFrame:
    """What texts of claims are made of (D1, D2 and D3 for all claims): their columns, product and policy_number, the first payment, and n, the place among its policy's claims, newest first."""
    rows = claims.select("policy_id", "claim_id", "claim_number", "claim_type", "status", "occurrence_date", "claim_amount")
    if payments is None:
        rows = rows.withColumns({c: F.lit(None).cast(t) for c, t in (("paid_amount", "double"), ("payment_date", "date"), ("payment_type", "string"))})
    else:
        paid = payments.groupBy("claim_id").agg(F.min(F.struct(*PAYMENT_ORDER)).alias("p"))
        rows = rows.join(paid, "claim_id", "left").select(*rows.columns, "p.paid_amount", "p.payment_date", "p.payment_type")
    order = W.partitionBy("policy_id").orderBy(F.desc("occurrence_date"), "claim_id")
    rows = rows.withColumn("n", F.row_number().over(order).cast("long"))
    return rows.join(policies.select("policy_id", "product", "policy_number"), "policy_id").drop("policy_id", "claim_id")


def _asked(plans: DataFrame, claims: DataFrame, policies: DataFrame) -> DataFrame:
    """The claims that few plans ask for: by their number, or as those of a policy."""
    keys = F.broadcast(plans.select("key").distinct())
    named = keys.select(F.col("key").alias("claim_number"), F.lit(True).alias("named"))
    owned = policies.join(keys, policies["policy_number"] == keys["key"], "left_semi").select("policy_id", F.lit(True).alias("owned")).distinct()
    return claims.join(named, "claim_number", "left").join(owned, "policy_id", "left").filter("named OR owned").drop("named", "owned")


def execute(plans: DataFrame, claims: DataFrame, policies: DataFrame, payments: DataFrame | None) -> DataFrame:
    """question_id, step, query, key, text of routed plans; a table that is missing costs its own rows alone.

    Plans are stored once, and so are claims with their policy and payment, so that the shuffles that made them can go. Plans then meet the columns that
    texts are made of, by number, and no texts are shuffled: a list of claims is written after its shuffle, other texts after the join.
    """
    known = stored((plans.filter("query <> 'get_claim_payment'") if payments is None else plans).select("question_id", "step", "query", "key"), "plans")
    if known.count() <= FEW_PLANS:
        claims = _asked(known, claims, policies)
    facts = stored(claim_facts(claims, policies, payments), "facts").withColumn("found", F.lit(True))
    q, key = F.col("query"), F.col("key")
    cols = lambda df, number: {c: F.col(c) for c in df.columns} | {number: key}
    told = lambda df, text: df.select("question_id", "step", "query", "key", F.coalesce(text, not_found(q, key)).alias("text"))
    of_claims = known.filter(q.isin("get_claim", "get_claim_payment")).join(facts.drop("n").withColumnRenamed("claim_number", "key"), "key", "left")
    row = cols(of_claims, "claim_number")
    rows = told(of_claims, F.when(F.col("found"), F.when(q == "get_claim", claim_text(row)).otherwise(payment_text(row))))
    own = policies.select(*(c for c in ("policy_number", "product", "start_date", "end_date", "status", "annual_premium") if c in policies.columns), F.lit(True).alias("found"))
    of_policies = known.filter(q == "get_policy").join(own.withColumnRenamed("policy_number", "key"), "key", "left")
    rows = rows.unionByName(told(of_policies, F.when(F.col("found"), policy_text(cols(of_policies, "policy_number")))))
    listed = facts.filter(F.col("n") <= LIST_MOST).groupBy(F.col("policy_number").alias("key"))
    listed = listed.agg(F.collect_list(F.struct("n", "claim_number", "claim_type", "status", "occurrence_date", "claim_amount", "paid_amount")).alias("c")).select("key", listed_text(F.col("c")).alias("text"))
    rows = rows.unionByName(told(known.filter(q == "list_claims_by_policy").join(listed, "key", "left"), F.col("text")))
    of_none = ~F.coalesce(q.isin("get_claim", "get_claim_payment", "get_policy", "list_claims_by_policy"), F.lit(False))
    return rows.unionByName(told(known.filter(of_none), F.lit(None).cast("string")))


def reconcile(claims: DataFrame, policies: DataFrame, payments: DataFrame, limits: DataFrame) -> DataFrame:
    """Per product and type: claims, claimed, paid, largest paid, and whether that is above the limit (product, limit_amount)."""
    c = claims.join(policies.select("policy_id", "product"), "policy_id").select("claim_id", "product", "claim_type", "claim_amount")
    paid = payments.groupBy("claim_id").agg(F.sum("paid_amount").alias("paid"), F.max("paid_amount").alias("most"))
    sums = c.join(paid, "claim_id", "left").groupBy("product", "claim_type").agg(F.count("*").alias("n_claims"), F.sum("claim_amount").alias("claimed"), F.sum("paid").alias("paid"), F.max("most").alias("max_paid"))
    return sums.join(limits, "product", "left").withColumn("above_limit", F.col("max_paid") > F.col("limit_amount"))
