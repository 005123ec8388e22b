"""Controlled vocabularies: relation types, entity types, confidence codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from caseloom.functions.text import WHITE_SPACE, bind, strip

# The controlled types and the words that lead to them.
ENTITY_TYPES = ["person", "organization", "object", "location", "event"]
RELATION_TYPES = """
PARTICIPATED_IN USED_IN OCCURRED_AT RESIDENCE_AT LOCATED_AT ASSOCIATED_WITH WITHIN SAME_AS
POSSIBLE_SAME_AS ALIAS_OF MEMBER_OF EMPLOYED_BY REPORTS_TO SUPERVISES REPRESENTS
COMMUNICATED_WITH MET_WITH COLLABORATED_WITH ORGANIZED PERPETRATED TARGET_OF WITNESS_OF
LOCATED_IN PRESENT_AT OWNS INVESTED_IN CONTROLS USES_ASSET BENEFITS_FROM
TRANSFERRED_TO SUPPLIED PAID RECEIVED_FROM MENTIONED_IN EXTRACTED_FROM EVIDENCE_FOR EVIDENCE_AGAINST
""".split()
TYPES_WITHOUT_OWN_WORD = ["PARTICIPATED_IN", "USED_IN", "RESIDENCE_AT", "LOCATED_AT", "ASSOCIATED_WITH"]
RELATION_WORDS = {
    "PARTICIPATED_IN": """communicated meeting talked discussed participated posted posted_by published reposted shared retweeted
        reported reporting stated_by authored_by quoted travel traveled moved arrived departed""",
    "USED_IN": """used utilized leveraged sent wired transferred shipped delivered transaction bought sold purchased
        procured""",
    "OCCURRED_AT": "happened_at took_place_at",
    "RESIDENCE_AT": "resides lives_at",
    "LOCATED_AT": "located based at",
    "ASSOCIATED_WITH": """associated related linked affiliated worked_with member part_of runs depicts depicted shows references
        referenced mentions mentioned co_mentioned shows_position_of position_of involves involved""",
    "WITHIN": "inside contained_in",
    "SAME_AS": "alias duplicate",
    "POSSIBLE_SAME_AS": """probably_same likely_same maybe_same similar similar_to similar_company_as probably_same_officer_as""",
    "ALIAS_OF": "also_known_as aka",
    "MEMBER_OF": "belongs_to affiliated_with joined",
    "EMPLOYED_BY": """employee_of staff_of officer_of director_of secretary_of treasurer_of president_of vice_president_of
        ceo_of cfo_of manager_of managing_director_of works_for works_at""",
    "REPORTS_TO": "reporting_to subordinate_to answers_to",
    "SUPERVISES": "oversees manages leads chairman_of",
    "REPRESENTS": """intermediary intermediary_of signatory signatory_of nominee nominee_of representative_of agent_of
        proxy_of attorney_of power_of_attorney""",
    "COMMUNICATED_WITH": "corresponded_with contacted emailed called messaged",
    "MET_WITH": "met meeting_with",
    "COLLABORATED_WITH": "cooperated_with partnered_with",
    "ORGANIZED": "organised planned arranged convened",
    "PERPETRATED": "committed carried_out executed",
    "TARGET_OF": "targeted_by victim_of",
    "WITNESS_OF": "witnessed observed saw",
    "LOCATED_IN": """resides_in lives_in based_in headquartered_in registered_in registered_address registered_office
        business_address mailing_address residential_address""",
    "PRESENT_AT": "seen_at observed_at attended",
    "OWNS": "member_of shareholder shareholder_of stockholder stockholder_of owned owner_of ownership partner_of",
    "INVESTED_IN": "investor_in funded financed",
    "CONTROLS": """beneficial_owner beneficial_owner_of controlled controller_of controlling dominates dominant
        ultimate_beneficial_owner ubo""",
    "USES_ASSET": "uses utilizes operates",
    "BENEFITS_FROM": "beneficiary beneficiary_of receives_benefits_from profits_from gains_from",
    "TRANSFERRED_TO": "transfer_to sent_to wired_to moved_to remitted_to shipped_to delivered_to",
    "SUPPLIED": "supplier_of provider_of furnished",
    "PAID": "payment_to paid_to remitted",
    "RECEIVED_FROM": "receives_from got_from incoming_from",
    "MENTIONED_IN": "cited_in referenced_in appears_in documented_in",
    "EXTRACTED_FROM": "derived_from sourced_from taken_from",
    "EVIDENCE_FOR": "proves supports corroborates confirms",
    "EVIDENCE_AGAINST": "contradicts refutes disproves undermines",
}
ENTITY_WORDS = {
    "organization": "org company corp ngo agency group institution gang organisation",
    "object": """asset artifact equipment cargo document report file certificate letter account bank_account iban
        device phone sim computer server laptop vehicle car truck van boat plane weapon firearm knife other
        unknown""",
    "location": "loc place city country region address building facility warehouse airport port",
    "event": """incident transaction transfer payment communication email message call phone_call meeting_event
        crime arrest""",
}
SUBTYPE_WORDS = {
    "asset": "asset artifact equipment cargo",
    "document": "document report file certificate letter",
    "account": "account bank_account iban",
    "device": "device phone sim computer server laptop",
    "vehicle": "vehicle car truck van boat plane",
    "weapon": "weapon firearm knife",
    "communication": "communication email message call phone_call",
}
FALLBACK_RELATION = "ASSOCIATED_WITH"
SCORES = {"repeated": 0.82, "single": 0.72, "unmatched": 0.48, "empty": 0.4}
BANDS = [(0.75, "high"), (0.55, "medium")]


def relation_vocabulary() -> dict[str, str]:
    """Word -> relation type: a type's own name, unless it has none, and the words listed for it."""
    return {**{t.lower(): t for t in RELATION_TYPES if t not in TYPES_WITHOUT_OWN_WORD}, **_word_groups(RELATION_WORDS)}


def _literal_map(mapping: dict[str, str]) -> Column:
    keys = F.array(*[F.lit(k) for k in mapping])
    values = F.array(*[F.lit(v) for v in mapping.values()])
    return F.map_from_arrays(keys, values)


def _word_groups(groups: dict[str, str]) -> dict[str, str]:
    return {word: target for target, words in groups.items() for word in words.split()}


def confidence_band(score: Column) -> Column:
    banded = F.when(score >= BANDS[0][0], BANDS[0][1])
    for floor, name in BANDS[1:]:
        banded = banded.when(score >= floor, name)
    return F.when(score.isNotNull(), banded.otherwise("low"))


def _relation_tokens(text: Column) -> Column:
    """The whole phrase joined by underscores, then its single words where they differ from it."""
    gaps = ",|;" + WHITE_SPACE
    words = F.filter(F.split(F.translate(F.lower(text), gaps, " " * len(gaps)), " "), lambda w: w != "")

    def listed(w: Column) -> Column:
        phrase = F.array_join(w, "_")
        return F.when(F.size(w) == 1, w).when(F.size(w) > 1, F.concat(F.array(phrase), w)).otherwise(w)

    return bind(words, listed)


def normalise_relation(texts: Column, words: dict[str, str] | None = None) -> Column:
    """struct(relation_type, raw_phrase, confidence_score, confidence_band) of an array of texts.

    The type named most often wins, the earlier one on a tie. The word list is a parameter.
    """
    vocabulary = words or relation_vocabulary()
    lookup, known = _literal_map(vocabulary), list(vocabulary)

    def winner(found: Column) -> Column:
        counted = F.transform(
            F.array_distinct(found), lambda d: F.struct(F.size(F.filter(found, lambda m: m == d)).alias("n"), d.alias("t"))
        )
        # the greatest count; among equals the first one, which the reduction meets first
        start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("t"))
        return F.aggregate(counted, start, lambda best, s: F.when(s["n"] > best["n"], s).otherwise(best))

    def answer(seen: Column) -> Column:
        tokens = F.flatten(F.transform(seen, _relation_tokens))
        # the set test is a hash lookup, the map is only searched for hits
        matched = F.transform(F.filter(tokens, lambda t: t.isin(known)), lambda t: F.try_element_at(lookup, t))

        def typed(b: Column) -> Column:
            score = (
                F.when(b["n"] > 1, SCORES["repeated"])
                .when(b["n"] == 1, SCORES["single"])
                .when(F.size(seen) > 0, SCORES["unmatched"])
                .otherwise(SCORES["empty"])
            )
            return F.struct(
                F.coalesce(b["t"], F.lit(FALLBACK_RELATION)).alias("relation_type"),
                F.try_element_at(seen, F.lit(1)).alias("raw_phrase"),
                score.alias("confidence_score"),
                confidence_band(score).alias("confidence_band"),
            )

        return bind(bind(matched, winner), typed)

    return bind(F.filter(F.transform(texts, strip), lambda t: t.isNotNull() & (t != "")), answer)


def _in_groups(c: Column, groups: dict[str, str]) -> Column:
    chosen = F.when(F.lit(False), F.lit(None).cast("string"))
    for target, words in groups.items():
        chosen = chosen.when(c.isin(words.split()), target)
    return chosen


def normalise_entity_type(raw: Column) -> Column:
    """One of the five types; unknown words and blanks are objects."""
    text = F.lower(strip(F.coalesce(raw, F.lit(""))))
    return F.when(text.isin(ENTITY_TYPES), text).otherwise(
        F.coalesce(_in_groups(text, ENTITY_WORDS), F.lit("object"))
    )


def entity_subtype(raw: Column) -> Column:
    """Finer tag of a raw type word, null where the five types say enough."""
    return _in_groups(F.lower(strip(raw)), SUBTYPE_WORDS)


def confidence_code(reliability: Column, validity: Column) -> Column:
    """Reliability A, B, C or X and validity 1 to 4 as one code; null marks a rejected row."""
    letter, digit = F.upper(strip(reliability)), strip(validity.cast("string"))
    valid = letter.isin("A", "B", "C", "X") & digit.isin("1", "2", "3", "4")
    return F.when(valid, F.concat(letter, digit))
