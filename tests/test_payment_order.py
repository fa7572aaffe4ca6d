"""Payments of one claim, date and number leave no tie to chance."""

import datetime

from cairn.operators import facts as D


def test_payments_with_one_date_and_number(spark):
    day = datetime.date(2024, 1, 1)
    policies = spark.createDataFrame([(1, "Auto", "AP-AUTO-000001", 1.0)], "policy_id long, product string, policy_number string, annual_premium double")
    claims = spark.createDataFrame([(5, 1, "SIN-2024-000005", "t", "F", day, 9.0)], "claim_id long, policy_id long, claim_number string, claim_type string, status string, occurrence_date date, claim_amount double")
    paid = [(5, 1, 30.0, day, "F"), (5, 1, 10.0, day, "O"), (5, 1, 10.0, day, "F"), (5, 1, 20.0, day, "F")]
    plans = spark.createDataFrame([(1, 1, "get_claim_payment", "SIN-2024-000005"), (1, 2, "list_claims_by_policy", "AP-AUTO-000001")], "question_id long, step long, query string, key string")
    for rows in (paid, paid[::-1], paid[2:] + paid[:2]):
        pay = spark.createDataFrame(rows, "claim_id long, payment_no int, paid_amount double, payment_date date, payment_type string").coalesce(1)
        r = D.claim_payment(claims, claims, policies, pay).first()
        assert (r.paid_amount, r.payment_date, r.payment_type) == (10.0, day, "F")
        assert all("paid_amount: R$ 10,00" in r.text for r in D.execute(plans, claims, policies, pay).collect())
