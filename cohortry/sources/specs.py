"""Extract specs for the usual subject areas of a record system.

``tables`` maps logical table names to frames; every frame carries ``pat_id`` and ``instance`` (ids are unique
per source system only) unless its keys below say otherwise. ``omit`` maps table names to columns to leave out;
it defaults to ``OMIT``, and ``{}`` keeps every column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortry.sources.extract import ExtractSpec, Part

# Columns that the published extractors leave out unless asked otherwise.
OMIT = {
    "encounter": [
        "obstetric_status", "mode_of_arrival", "appointment_datetime", "appointment_status", "arrival_datetime", "confirmation_status", "cancel_reason",
        "expected_admission_date", "expected_discharge_date", "discharge_destination", "discharge_transportation", "accomodation_code", "acuity",
        "facility_state", "facility_zip", "hospital_area_id", "hsp_account_id", "admission_prov_id", "discharge_prov_id", "visit_prov_id", "bed_id",
        "bill_attend_prov_id", "ed_episode_id", "ip_episode_id", "pri_problem_id", "room_id",
    ],
    "adtevent": ["adt_room_id", "adt_bed_id"],
    "encounteradmissionreason": ["pat_enc_date_real"],
    "encounterchiefcomplaint": ["pat_enc_date_real"],
    "encounterdiagnosis": ["pat_enc_date_real"],
    "medicalhistory": [],
    "notes": ["author_provider_type", "author_user_id", "entry_user_id"],
    "medicationorders": ["authorizing_prov_id", "department_id", "ord_prov_id", "order_priority", "order_set", "requested_instant_utc"],
    "medication": ["controlled"],
    "medicationadministration": ["due_datetime", "scheduled_for_datetime", "scheduled_on_datetime"],
    "procedureorders": [
        "parent_order_id", "order_priority", "order_set", "referral_class", "referral_expiration_date", "referral_number_of_visits", "referral_priority",
        "referral_reason", "referral_type", "referred_to_department_id", "referred_to_facility_id", "referred_to_specialty", "requested_instant_utc",
        "future_or_stand", "authorizing_prov_id",
    ],
    "cardiovascularfinding": ["ord_date_real", "finding_id"],
    "labresult": ["organism_id", "organism_name", "organism_quantity", "organism_quantity_unit", "compon_lnc_id", "default_lnc_id", "fulladd_lresult_comment"],
}

PERSON = ["pat_id", "instance"]
ENCOUNTER = [*PERSON, "pat_enc_csn_id"]


def _part(tables: dict[str, DataFrame], name: str, keys: list[str], omit: dict | None) -> Part:
    return Part(tables[name], keys, omit=tuple((OMIT if omit is None else omit).get(name, ())))


def _options(tables, names: dict[str, list[str]], omit) -> dict[str, Part]:
    return {n: _part(tables, n, k, omit) for n, k in names.items() if n in tables}


def encounters(tables: dict[str, DataFrame], omit: dict | None = None) -> ExtractSpec:
    names = ["adtevent", "encounteradmissionreason", "encounterchiefcomplaint", "encounterdiagnosis", "medicalhistory", "notes"]
    lookups = (_part(tables, "department", ["department_id", "instance"], omit),) if "department" in tables else ()
    return ExtractSpec(
        _part(tables, "encounter", PERSON, omit), _options(tables, dict.fromkeys(names, ENCOUNTER), omit), lookups,
        ("contact_date", "birth_date", "age_at_contact_dt"),
    )


def medication_orders(tables: dict[str, DataFrame], omit: dict | None = None) -> ExtractSpec:
    return ExtractSpec(
        _part(tables, "medicationorders", PERSON, omit),
        _options(tables, {"medicationadministration": [*PERSON, "order_med_id"]}, omit),
        (_part(tables, "medication", ["medication_id", "instance"], omit),),
        ("ordering_datetime", "birth_date", "age_at_order_dt"),
    )


def procedure_orders(tables: dict[str, DataFrame], omit: dict | None = None) -> ExtractSpec:
    keys = [*PERSON, "order_proc_id"]
    return ExtractSpec(
        _part(tables, "procedureorders", PERSON, omit), _options(tables, {"labresult": keys, "cardiovascularfinding": keys}, omit),
        (), ("ordering_datetime", "birth_date", "age_at_order_dt"),
    )


def flowsheets(tables: dict[str, DataFrame], omit: dict | None = None) -> ExtractSpec:
    """Sheet → entry → definition → code mapping; the chain hangs together on its own ids."""
    measure = ["flo_meas_id", "instance"]
    lookups = [
        _part(tables, "flowsheetentry", ["fsd_id", "instance", "inpatient_data_id"], omit),
        _part(tables, "flowsheetdefinition", measure, omit),
        _part(tables, "conceptmapping", measure, omit),
    ]
    visit = ["inpatient_data_id", *PERSON]
    return ExtractSpec(
        _part(tables, "flowsheet", PERSON, omit), _options(tables, {"inpatientdata": visit, "inpatientdataflowsheet": visit}, omit),
        tuple(lookups), ("recorded_time", "birth_date", "age_at_recorded_dt"),
    )


def problem_list(tables: dict[str, DataFrame], omit: dict | None = None) -> ExtractSpec:
    lookups = (_part(tables, "diagnosis", ["dx_id", "instance"], omit),) if "diagnosis" in tables else ()
    return ExtractSpec(_part(tables, "problemlist", PERSON, omit), {}, lookups, ("noted_date", "birth_date", "age_at_noted_dt"))


def episodes(tables: dict[str, DataFrame], omit: dict | None = None) -> ExtractSpec:
    return ExtractSpec(
        _part(tables, "summaryblock", PERSON, omit),
        _options(tables, {"summaryblockdeliverysummary": ["episode_id", "instance"], "summaryblockobhistory": ["episode_id", "instance"]}, omit),
        (), ("start_date", "birth_date", "age_at_start_dt"),
    )
