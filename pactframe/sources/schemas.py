"""Declared schemas: the domain tables, and the base test tables behind them."""

from __future__ import annotations


def _schema(text: str) -> str:
    """One-line DDL, which the reader turns into the same StructType."""
    return " ".join(text.split())


DOMAIN_SCHEMAS = {
    name: _schema(ddl)
    for name, ddl in {
        "accounts": """id string not null, name string not null, plan string, credits_included int,
            credits_used int, credits_banked int, period_started_at timestamp, billing_email string, billing_country string,
            vat_number string, billing_status string, billing_customer_id string, billing_subscription_id string,
            last_failed_invoice string, marketing_opt_in boolean, signup_source string, created_at timestamp""",
        "account_members": "user_id string not null, account_id string not null, role string",
        "credit_ledger": """id bigint not null, account_id string not null, user_id string, contract_id string,
            kind string not null, credits int not null, created_at timestamp""",
        "contracts": """id string not null, account_id string not null, ref string, name string,
            supplier string not null, category string, annual_value decimal(18,2), currency string,
            start_date date, end_date date, notice_period_days int, auto_renew boolean, users_count int,
            analysis variant""",
        "documents": """id string not null, account_id string not null, contract_id string,
            name string not null, doc_type string, size_bytes bigint, extracted_text string, storage_path string, consent_id string,
            is_transcript boolean, ocr_applied boolean, ocr_chars int, scanned boolean, page_count int,
            created_at timestamp""",
        "contract_users": """id bigint not null, account_id string not null, contract_id string,
            full_name string, email string, team string, last_active date, licence_type string""",
        "analyses": """id bigint not null, account_id string not null, contract_id string,
            analysis variant not null, created_at timestamp""",
        "data_points": """id bigint not null, account_id string not null, contract_id string not null,
            analysis_id bigint, field string not null, kind string not null, value string,
            confidence int not null, reasoning string, source_ref string, tier string, status string,
            corrected_value string, ground_truth string, was_correct boolean, created_at timestamp""",
        "verification_audit": """id bigint not null, account_id string not null, data_point_id bigint not null,
            user_id string, action string not null, value_before string, value_after string,
            created_at timestamp""",
        "jobs": """id string not null, account_id string not null, contract_id string, kind string not null,
            payload variant not null, status string not null, priority int not null, attempts int not null,
            max_attempts int not null, run_after timestamp not null, locked_by string, heartbeat_at timestamp,
            error string, result variant, enqueued_at timestamp, started_at timestamp, finished_at timestamp,
            progress int, progress_note string, requested_by string, idempotency_key string""",
        "policy_packs": """id string not null, account_id string, key string not null, name string not null,
            jurisdiction string not null, version string not null, rules array<string> not null,
            active boolean not null, effective_from timestamp, effective_to timestamp""",
        "analysis_policy_snapshot": "analysis_id bigint not null, pack_id string not null",
        "telemetry_events": """id bigint not null, account_id string, op string not null, duration_ms int,
            tokens_in int, tokens_out int, cached_tokens int, queue_wait_ms int, ok boolean,
            error_class string, worker string, created_at timestamp""",
        "transcript_consents": """id string not null, account_id string not null, accepted_by string,
            accepted_name string not null, version string not null, accepted_at timestamp""",
        "obligation_tracking": """id string not null, account_id string not null, contract_id string not null,
            obligation_ix int not null, obligation string not null, party string, assignee_id string,
            due_date date, status string not null, completed_at timestamp""",
        "profiles": """id string not null, email string not null, full_name string,
            terms_accepted_at timestamp, terms_version string""",
        "invitations": """id string not null, account_id string not null, email string not null,
            role string not null, token string not null, expires_at timestamp not null, accepted_at timestamp""",
    }.items()
}

BASE_SCHEMAS = {
    name: _schema(ddl)
    for name, ddl in {
        "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
        "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
        "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
        "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
            o_orderdate timestamp, o_orderpriority string""",
        "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
            l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,
            l_shipdate timestamp""",
        "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
        "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
        "conversations": "conv_id bigint, turn bigint, role string, text string",
    }.items()
}
