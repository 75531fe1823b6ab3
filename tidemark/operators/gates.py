"""Gates: ordered rules on columns that decide what becomes of urls, sources, change events and facts. All of them are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import patterns as P
from tidemark.functions import text as T
from tidemark.functions import urls as U

from .changes import first_rule


def clean_key(c: Column) -> Column:
    """Lower case, white space and underscores as single hyphens, only a-z, 0-9 and hyphens; empty for null."""
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))), r"[\s_]+", "-")
    return F.regexp_replace(F.regexp_replace(key, "[^a-z0-9-]+", ""), "-+", "-")


def verdict(reason: Column, allowed: list[str] | Column) -> Column:
    """struct(allowed, reason)."""
    good = reason.isin(allowed) if isinstance(allowed, list) else allowed
    return F.struct(good.alias("allowed"), reason.alias("reason"))


# --- urls


def discovery_only(url: Column) -> Column:
    """Hosts that list awards of others."""
    return F.coalesce(U.host(url).isin(P.DISCOVERY_HOSTS), F.lit(False))


def hard_blocked(url: Column) -> Column:
    """Urls that never show an award: no http, no host, access, career, payment, search and listing paths, tracking parameters."""
    path = U.path(url)
    rules = (
        ~F.lower(url).rlike("^https?://") | U.host(url).isNull() | U.host(url).isin(P.CMS_HOSTS + P.DOWNLOAD_HOSTS) | path.rlike(P.PHONE_PATH) | path.rlike(P.HARD_PATH)
        | url.rlike(P.TRACKING_QUERY) | path.rlike(P.CAREER_PATH) | path.rlike(P.PAYMENT_PATH) | path.rlike(P.SEARCH_PATH) | path.rlike(P.LISTING_PATH)
    )
    return url.isNotNull() & F.coalesce(rules, F.lit(False))


def non_award(url: Column) -> Column:
    """Hard-blocked urls and files that aren't pages."""
    return hard_blocked(url) | F.coalesce(U.path(url).rlike(P.ASSET_PATH), F.lit(False))


def trackable(url: Column) -> Column:
    """Urls that the public may follow."""
    return (F.coalesce(url, F.lit("")) != "") & ~discovery_only(url) & ~non_award(url)


def spam_upload(url: Column, title: Column) -> Column:
    """Uploaded html files whose title or path advertises."""
    path = U.path(url)
    return F.coalesce(path.rlike(P.UPLOAD_PATH) & F.concat_ws(" ", title, path).rlike(P.SPAM_TITLE), F.lit(False))


# --- sources


def review_status(metadata: Column) -> Column:
    """struct(status, reason, usable) of the review that metadata (JSON) holds: unreviewed, failed, incomplete, rejected, unclear or accepted."""
    at = lambda path: F.get_json_object(metadata, f"$.{path}")
    key = lambda path: clean_key(at(path))
    generated, model, facts = at("generated_at").isNotNull(), at("model").isNotNull(), F.coalesce(at("baseline_facts"), F.lit("{}")) != "{}"
    rejected = F.coalesce(at("baseline_facts_rejected") == "true", F.lit(False))
    failed, error = key("status").isin("failed", "error"), key("error")
    flags = F.transform(F.from_json(F.coalesce(at("quality_flags"), F.lit("[]")), "array<string>"), clean_key)
    hard = F.get(F.filter(flags, lambda f: f.isin(P.REJECTED_SOURCE_FLAGS)), F.lit(0))
    relevance, cycle, confidence = key("baseline_facts.award_relevance"), key("baseline_facts.cycle_relevance"), key("baseline_facts.confidence")
    why = key("rejection_reason")
    accepted = F.when(relevance == "primary", "reviewed_accepted_primary").otherwise("reviewed_accepted_supporting")
    incomplete, unclear = F.lit("reviewed_invalid_or_incomplete"), F.lit("reviewed_unclear_needs_manual_review")
    pair = lambda status, reason: F.struct((F.lit(status) if isinstance(status, str) else status).alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    rules = [
        (~generated & ~facts & ~rejected, pair("unreviewed", "missing_page_metadata_generated_at_and_baseline_facts")),
        (failed, pair("review_failed", F.concat(F.lit("review_status_"), key("status")))),
        (error != "", pair("review_failed", F.concat(F.lit("review_error_"), error))),
        (~generated, pair(incomplete, "missing_page_metadata_generated_at")),
        (~model, pair(incomplete, "missing_page_metadata_model")),
        (~facts & ~rejected, pair(incomplete, "missing_baseline_facts_or_rejection")),
        (hard.isNotNull(), pair(rejected_as(hard), F.concat(F.lit("quality_flag_"), hard))),
        (rejected & (why == ""), pair(incomplete, "baseline_facts_rejected_missing_rejection_reason")),
        (rejected, pair(rejected_as(why), F.concat(F.lit("baseline_facts_rejected_"), why))),
        (relevance == "", pair(incomplete, "missing_award_relevance")),
        (relevance == "unclear", pair(unclear, "award_relevance_unclear")),
        (relevance == "unrelated", pair("reviewed_rejected_unrelated", "award_relevance_unrelated")),
        (~relevance.isin("primary", "supporting"), pair(incomplete, F.concat(F.lit("unknown_award_relevance_"), relevance))),
        (cycle == "", pair(incomplete, "missing_cycle_relevance")),
        (cycle == "unclear", pair(unclear, "cycle_relevance_unclear")),
        (cycle == "not-program-page", pair("reviewed_rejected_not_program_page", "cycle_relevance_not_program_page")),
        (cycle == "archived-or-past", pair("reviewed_rejected_archived_or_past", "cycle_relevance_archived_or_past")),
        (confidence == "low", pair(unclear, "confidence_low")),
    ]
    found = F.coalesce(*[F.when(c, p) for c, p in rules], pair(accepted, "accepted"))
    return F.struct(found["status"].alias("status"), found["reason"].alias("reason"), found["status"].startswith("reviewed_accepted").alias("usable"))


def rejected_as(signal: Column) -> Column:
    """The status that a rejecting flag or reason leads to."""
    has = lambda *parts: F.greatest(*[F.contains(signal, F.lit(p)) for p in parts]) if len(parts) > 1 else F.contains(signal, F.lit(parts[0]))
    return (
        F.when(has("sibling", "unrelated-program"), "reviewed_rejected_sibling_program").when(has("archive", "past"), "reviewed_rejected_archived_or_past")
        .when(has("not-program"), "reviewed_rejected_not_program_page").when(has("access", "captcha", "security", "login"), "reviewed_rejected_access_error")
        .when(has("generic", "listing", "search", "job", "career", "payment", "profile", "recipient", "news"), "reviewed_rejected_generic_listing")
        .otherwise("reviewed_rejected_unrelated")
    )


def source_quality(url: Column, title: Column, metadata: Column, purpose: str, review: Column | None = None) -> Column:
    """struct(allowed, reason) of a source for a purpose: public, facts, monitoring, discovery, admin or debug. review: its review_status, if that is a column already."""
    at = lambda path: F.get_json_object(metadata, f"$.{path}")
    rules = [("missing_url", F.coalesce(url, F.lit("")) == "")]
    if purpose in ("monitoring", "discovery"):
        rules.append(("url_not_monitorable", ~trackable(url)))
    else:
        rules.append(("url_not_public_trackable", ~trackable(url)))
    rules.append(("url_spam_upload_html", spam_upload(url, title)))
    bad = first_rule(rules)
    if purpose in ("public", "facts", "monitoring"):
        review = review_status(metadata) if review is None else review
        judged = F.when(review["usable"], F.concat(F.lit("ai_review_"), review["status"])).otherwise(F.concat_ws("_", F.lit("ai_review"), review["status"], review["reason"]))
        return verdict(F.coalesce(bad, judged), bad.isNull() & review["usable"])
    flags = F.transform(F.from_json(F.coalesce(at("quality_flags"), F.lit("[]")), "array<string>"), clean_key)
    hard = F.get(F.filter(flags, lambda f: f.isin(P.REJECTED_SOURCE_FLAGS)), F.lit(0))
    facts = F.coalesce(at("baseline_facts"), F.lit("{}")) != "{}"
    relevance, cycle = clean_key(at("baseline_facts.award_relevance")), clean_key(at("baseline_facts.cycle_relevance"))
    strict = F.lit(purpose == "discovery")
    later = [
        ("baseline_facts_rejected", at("baseline_facts_rejected") == "true"), ("award_relevance_unrelated", facts & (relevance == "unrelated")),
        ("award_relevance_unclear", facts & relevance.isin("", "unclear") & strict), ("cycle_relevance_not_program_page", facts & (cycle == "not-program-page")),
        ("cycle_relevance_archived_or_past", facts & (cycle == "archived-or-past")), ("cycle_relevance_unclear", facts & cycle.isin("", "unclear") & strict),
    ]
    reason = F.coalesce(bad, first_rule(later[:1]), F.concat(F.lit("quality_flag_"), hard), first_rule(later[1:]), F.lit("allowed"))
    return verdict(reason, ["allowed"])


# --- change events


def already_suppressed(suppressed_at: Column, details: Column) -> Column:
    """Whether a change was suppressed before, in its own column or in its details (JSON)."""
    inside = lambda k: F.coalesce(F.get_json_object(details, f"$.{k}"), F.lit("")) != ""
    return suppressed_at.isNotNull() | inside("suppressed_at") | inside("suppression_reason")


def suppression_reason(
    suppressed_at: Column, source_id: Column, source_found: Column, review_state: Column, source_text: Column, quality: Column, details: Column, summary: Column
) -> Column:
    """Why a change event is suppressed, the first rule that holds; null if it is published. details is JSON, quality a struct of source_quality."""
    at = lambda path: F.get_json_object(details, f"$.{path}")
    parts = F.from_json(F.coalesce(at("structured_diff.added_text"), F.lit("[]")), "array<string>")
    evidence = F.array_join(parts, " ")
    words = F.concat_ws(" ", summary, at("reader_summary"), evidence)
    applicant, proven = words.rlike(P.APPLICANT), evidence.rlike(P.APPLICANT)
    shape = source_text.rlike(P.SHAPE_SOURCE)
    escapes = (quality["reason"] == "url_not_monitorable") & shape & proven
    flags = F.transform(F.from_json(F.coalesce(at("quality_flags"), F.lit("[]")), "array<string>"), clean_key)
    flag = F.get(F.filter(flags, lambda f: f.isin(P.REJECTED_CHANGE_FLAGS)), F.lit(0))
    noise = [(reason, words.rlike(pattern) & ~applicant) for reason, pattern in P.NOISE_SUMMARIES]
    return F.coalesce(
        F.when(already_suppressed(suppressed_at, details), F.coalesce(at("suppression_reason"), F.lit("already_suppressed"))),
        F.when(source_id.isNotNull() & ~source_found, "source_missing"),
        F.when(source_found & (F.coalesce(review_state, F.lit("open")) != "open"), F.concat(F.lit("source_status_"), clean_key(review_state))),
        F.when(source_found & ~quality["allowed"] & ~escapes, F.concat(F.lit("source_quality_"), quality["reason"])),
        F.when(at("is_alert_worthy") == "false", "not_alert_worthy"),
        F.when(clean_key(at("generation_status")) == "rejected", "generation_status_rejected"),
        F.concat(F.lit("quality_flag_"), F.replace(flag, F.lit("-"), F.lit("_"))),
        F.when(source_text.rlike(P.BAD_SOURCE) | shape & ~proven, "source_shape_noise"),
        first_rule(noise),
    )


def alert_worthy(flags: Column) -> Column:
    """No flag stands against an alert; null flags don't."""
    return ~F.coalesce(F.arrays_overlap(flags, F.array(*[F.lit(f) for f in P.NOT_ALERT_WORTHY])), F.lit(False))


def useful_summary(summary: Column) -> Column:
    """Whether a summary says something: long enough, no empty opening or phrase, no cut end, no boilerplate."""
    clean = T.collapse(F.coalesce(summary, F.lit("")))
    low = F.lower(clean)
    words = F.filter(F.split(low, " "), lambda w: w != "")
    last = F.regexp_replace(F.coalesce(F.element_at(F.array_append(words, F.lit("")), -2), F.lit("")), "[^a-z0-9]+", "")
    quotes = F.length(clean) - F.length(F.replace(clean, F.lit('"'), F.lit("")))
    cut = (F.size(words) < 6) | ((quotes % 2 == 1) & (F.length(clean) < 120)) | last.isin(P.LAST_WORDS)
    empty = F.lit(False)
    for opening in P.EMPTY_OPENINGS:
        empty = empty | low.startswith(opening)
    for phrase in P.EMPTY_PHRASES:
        empty = empty | F.contains(low, F.lit(phrase))
    return (F.length(clean) >= 28) & ~cut & ~empty & ~low.rlike(P.BOILERPLATE)


# --- facts


def identity_tokens(c: Column) -> Column:
    """Telling words of an award's name: no brackets, longer than two characters, no common words; 30 at most."""
    spelled = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("&"), F.lit(" and "))
    plain = F.regexp_replace(F.regexp_replace(spelled, r"\([^)]*\)", " "), "[^a-z0-9]+", " ")
    return F.slice(F.filter(F.split(F.trim(plain), " "), lambda w: (F.length(w) > 2) & ~w.isin(P.IDENTITY_STOP_WORDS)), 1, 30)


def identity_score(name: Column, source_text: Column, relevance: Column, same_homepage: Column) -> Column:
    """How surely a source is about an award: shared words of its name, with bonuses and a malus, from 0 to 1."""
    own, other = identity_tokens(name), identity_tokens(source_text)
    shared = F.size(F.filter(own, lambda t: F.array_contains(other, t))) / F.size(own)
    bonus = F.when(relevance == "primary", 0.25).when(relevance == "supporting", 0.12).otherwise(0.0) + F.when(same_homepage, 0.2).otherwise(0.0)
    malus = F.when(source_text.rlike(P.GENERIC_SOURCE), 0.15).otherwise(0.0)
    return F.when(F.size(own) == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), shared + bonus - malus)))


def may_give(field: Column, page_type: Column, relevance: Column, source_text: Column, identity: Column) -> Column:
    """Whether a source of a page type may give a field of an award's facts."""
    by_type = F.lit(True)
    for kind, fields in P.FIELDS_OF_PAGE_TYPE.items():
        by_type = F.when(page_type == kind, field.isin(fields)).otherwise(by_type)
    primary = (relevance == "primary") & page_type.isin("homepage", "deadline", "eligibility", "requirements", "faq")
    fits = F.when(field.isin(P.PRIMARY_FIELDS), primary).otherwise(by_type)
    return (identity >= 0.35) & ~source_text.rlike(P.GENERIC_SOURCE) & fits


#: What candidate_verdict finds wrong with a candidate.
CANDIDATE_FAULTS = ["empty_value", "sibling_program_identity_mismatch", "field_not_allowed_for_source_role", "missing_exact_evidence"]


def candidate_verdict(value: Column, evidence: Column, field: Column, allowed: Column, identity: Column) -> Column:
    """struct(allowed, reason) of a candidate fact: empty, wrong source, no evidence or accepted."""
    reason = first_rule([
        ("empty_value", F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"[.;:\s]+$", "") == ""),
        ("sibling_program_identity_mismatch", ~allowed & (identity < 0.35)),
        ("field_not_allowed_for_source_role", ~allowed),
        ("missing_exact_evidence", (F.trim(F.coalesce(evidence, F.lit(""))) == "") & ~field.isin(P.URL_FIELDS)),
    ], "accepted")
    return verdict(reason, ["accepted"])


# --- health


def health_kind(error: Column, status: Column, checked: Column) -> Column:
    """What the latest check of a source found: one of twelve kinds."""
    text = F.lower(F.trim(F.coalesce(error, F.lit(""))))
    http = F.nullif(F.regexp_extract(text, r"\b(?:http|status)\s*:?[\s-]*([0-9]{3})\b", 1), F.lit("")).cast("int")
    any_of = lambda parts: F.greatest(*[F.contains(text, F.lit(p)) for p in parts], F.lit(False))
    return first_rule([
        ("failed", (text == "") & (status == "error")), ("ok", (text == "") & checked.isNotNull()), ("pending", text == ""), ("certificate", F.contains(text, F.lit("certificate")) | F.contains(text, F.lit("cert_has_expired"))),
        ("missing", http.isin(404, 410)), ("blocked", http.isin(401, 403, 405)), ("rate_limited", http == 429), ("server_error", http >= 500),
        *[(kind, any_of(parts)) for kind, parts in P.HEALTH_TEXTS],
    ], "failed")


def failure_bucket(error: Column) -> Column:
    """What cleanups call a failure; none without an error."""
    text = F.trim(F.coalesce(error, F.lit("")))
    return F.when(text == "", "none").otherwise(T.first_match(P.FAILURE_BUCKETS, text, "other_failure"))


def cleanup_action(duplicate: Column, policy: Column, bucket: Column, useful: Column) -> Column:
    """struct(action, reason): remove, replace, keep though blocked, or nothing. useful: how many useful sources the award has."""
    dead, blocked = bucket.isin("404_gone", "410_gone", "dead_dns"), ~bucket.isin("404_gone", "410_gone", "dead_dns", "none")
    action = (
        F.when(duplicate | policy.isNotNull() | dead & (useful > 0), "safe_to_remove").when(dead, "needs_replacement").when(blocked, "keep_but_blocked").otherwise("no_action")
    )
    reason = F.when(duplicate, "duplicate_source").otherwise(F.coalesce(policy, F.when(dead | blocked, bucket), F.lit("healthy_or_unchecked")))
    return F.struct(action.alias("action"), reason.alias("reason"))


def hygiene_reason(url: Column, title: Column, failure: Column) -> Column:
    """Why a source is put aside for a later look, the first rule that holds; null if it is kept. Rules for single hosts are left to the caller."""
    host, path = F.coalesce(U.host(url), F.lit("")), F.lower(F.coalesce(U.path(url), F.lit("")))
    words = F.lower(F.concat_ws(" ", url, title))
    message = F.coalesce(failure, F.lit(""))
    return first_rule([
        ("invalid_url", host == ""), ("social_or_share_link", host.rlike(P.of_hosts(P.SOCIAL_HOSTS)) | words.rlike(P.SOCIAL_TEXT) | path.rlike("/share(?:/|$)")), ("media_or_archive_file", path.rlike(P.MEDIA_PATH)),
        ("recursive_or_cyclic_url", U.repeats_segment(url)), ("generic_source_shape", path.rlike(P.SEARCH_PATH) | path.rlike(P.LISTING_PATH)),
        ("software_download", host.isin(P.DOWNLOAD_HOSTS)), ("boilerplate_or_policy_link", words.rlike(P.BOILERPLATE_TEXT)), ("oversized_file", message.rlike(P.TOO_LARGE)),
        ("private_document", host.rlike(P.of_hosts(P.PRIVATE_HOSTS)) & message.rlike(P.PRIVATE_FAILURE)), ("permanent_http_failure", message.rlike(P.PERMANENT_FAILURE)), ("soft_404", message.rlike(P.SOFT_404)),
        ("blocked_third_party", host.rlike(P.of_hosts(P.BLOCKED_HOSTS)) & message.rlike(P.BLOCKED_FAILURE)), ("blocked_by_source", message.rlike(P.BLOCKED_FAILURE)),
    ])


def review_gate(quality: Column, source_text: Column, class_: Column, text: Column) -> Column:
    """struct(allowed, reason) of a change before it goes to review: its source, its kind, noise, and what applicants look for."""
    shape, applicant = source_text.rlike(P.SHAPE_SOURCE), text.rlike(P.APPLICANT)
    escapes = (quality["reason"] == "url_not_monitorable") & shape & applicant
    noise = first_rule([(reason, text.rlike(pattern) & ~applicant) for reason, pattern in P.NOISE_SUMMARIES])
    reason = F.coalesce(
        F.when(~quality["allowed"] & ~escapes, F.concat(F.lit("source_quality_"), quality["reason"])), F.when((source_text.rlike(P.BAD_SOURCE) | shape) & ~escapes, "source_shape_noise"),
        F.when(class_ == "none", "missing_added_or_removed_text_evidence"), noise, F.when(class_.isin("amount", "date"), "applicant_fact_signal"), F.when(applicant, "text_only_applicant_signal"),
        F.lit("text_only_noise_without_applicant_signal"),
    )
    return verdict(reason, ["applicant_fact_signal", "text_only_applicant_signal"])


def source_score(url: Column, page_type: Column, words: Column, shared: Column, error: Column, generic: Column) -> Column:
    """struct(score, signals) of a source: points for https, page type, intent and shared words of the award's name, less for errors, queries and generic titles."""
    https, protected, intent = F.lower(url).startswith("https:"), page_type.isin(P.PROTECTED_PAGE_TYPES), F.lower(words).rlike(P.INTENT)
    fine = F.trim(F.coalesce(error, F.lit(""))) == ""
    points = lambda c, n, other=0: F.when(c, n).otherwise(other)
    score = (
        points(https, 8) + points(protected, 18) + points(intent, 28) + points(shared >= 2, 45) + points(shared == 1, 20) + points(fine, 8, -10) - points(U.query_string(url) != "", 8)
        - points(generic, 18) - points(page_type == "other", 6)
    )
    named = [("https", https), ("page_type", protected), ("award_intent", intent), ("award_tokens", shared >= 2), ("award_token", shared == 1), ("no_error", fine), ("has_error", ~fine)]
    return F.struct(score.alias("score"), F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named])).alias("signals"))
