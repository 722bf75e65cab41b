"""Vocabularies of the data model. They have to match what stored documents hold, and stand in their order."""

from __future__ import annotations

EVENT_TYPES = """ceremonial_or_award_event announcement_only personnel_transfer cultural_or_sports_event flood urban_waterlogging
cyclone_storm_damage heat_wave cold_wave drought landslide tree_fall fire pollution waste_management disaster_relief_operation
drinking_water_shortage irrigation_water_issue canal_or_water_body_issue borewell_or_well_issue disease_outbreak hospital_service_gap
medicine_shortage food_safety veterinary_disease malnutrition sanitation_hygiene school_infrastructure teacher_or_staff_shortage
exam_or_admission_disruption student_welfare_issue road_damage bridge_or_culvert_safety public_building_damage power_supply_disruption
streetlight_failure telecom_disruption traffic_congestion road_safety_hazard transport_service_issue vehicle_accident crop_damage
pest_or_disease_outbreak agricultural_compensation_issue market_price_distress farm_labour_dispute violent_crime property_crime
substance_abuse_case women_safety_issue public_disturbance communal_tension cyber_or_financial_fraud protest_or_strike
legal_proceeding_or_order land_dispute illegal_encroachment unauthorised_construction tenancy_or_eviction_issue payout_or_records_issue
forest_land_issue service_delivery_delay public_scheme_grievance pension_or_wage_dispute employment_dispute election_process_issue
transparency_or_accountability relief_fund_misuse other unresolved""".split()
DEPARTMENTS = """collectorate revenue rural_development_panchayat_raj urban_local_bodies district_disaster_management water_resources
public_health education agriculture horticulture animal_husbandry fisheries forest environment_climate_change pwd_highways_rural_roads
housing_community_development power_tangedco transport_motor_ways police prohibition_subordinate_service social_welfare
backward_classes_tbct tribal_welfare women_child_development labour_employment cooperation food_civil_supplies msme_tire
information_public_relations elections youth_services_sports other unresolved""".split()
CATEGORIES = "disaster water agriculture health education infrastructure transport law_and_order land environment social_welfare public_service other unresolved".split()
EVENT_STATUSES = "reported ongoing under_investigation action_taken resolved unknown".split()
RECORD_KINDS = "incident forecast context unresolved".split()
CONTEXT_TYPES = "market_price weather_forecast administrative_notice general_information other".split()
REVIEW_STATES = "accepted review_required unresolved".split()
ENTITY_TYPES = """person government_official government_body organization community_group political_party media_outlet institution
hospital school market village taluk block other unknown""".split()
RELATIONSHIPS = "located_at involves responds_to related_to other".split()
ISSUE_CODES = """unsupported_claim span_mismatch invalid_value unknown_field unauthorised_gis_value unresolved_reference
missing_provenance ambiguous_quote provider_warning uncertain_recognition""".split()
MENTION_TYPES = """district taluk block village town locality street ward institution government_body water_body agricultural_field
project other unknown""".split()
MENTION_ROLES = "event_location event_container institution_name actor_affiliation reporting_origin mentioned_only unresolved".split()
RESOLUTIONS = "not_attempted pending_gis ambiguous resolved rejected".split()
PRECISIONS = "second minute hour day week month quarter year decade unknown".split()
METHODS = "source_metadata regex rule dictionary statistical llm human unresolved".split()
SPAN_STATES = "unvalidated validated mismatch not_applicable".split()
MODALITIES = "text image pdf scanned_document audio_transcript structured_data unknown".split()
ACTOR_ROLES = """reported_by responding_authority decision_maker affected_party beneficiary petitioner_or_complainant action_subject
representative_or_union witness other unknown""".split()

EVENT_ROLES = ["event_location", "event_container"]
FORECAST_WORDS = ["forecast", "weather", "temperature", "humidity", "rain", "rains", "wind", "winds", "heat", "முன்னறிவிப்பு", "வானிலை", "வெப்பநிலை", "வெப்பம்", "ஈரப்பதம்", "மழை", "காற்று"]
MARKET_WORDS = ["price", "prices", "pricing", "rate", "rates", "mandi", "santhai", "uzhavar", "per kg", "rupee", "rupees", "விலை", "சந்தை", "உழவர்"]
CLAIM_WORDS = ["confirmed", "statistically significant", "proves", "proof", "caused by"]
PAST_WORDS = ["completed", "was done", "has been done", "action taken", "was ordered", "was instructed", "carried out", "already repaired", "already cleared", "resolved by"]
MONTHS_TAMIL = {"ஜன": 1, "பிப்": 2, "மார்": 3, "ஏப்": 4, "மே": 5, "ஜூன்": 6, "ஜூலை": 7, "ஆக": 8, "செப்": 9, "அக்": 10, "நவ": 11, "டிச": 12}
TALUK_SPELLINGS = {
    "madurai north": "Madurai North", "madurai south": "Madurai South", "madurai east": "Madurai East", "madurai west": "Madurai West", "melur": "Melur",
    "thirumangalam": "Thirumangalam", "tirumangalam": "Thirumangalam", "thiruparankundram": "Thiruparankundram", "thirupparankundram": "Thiruparankundram",
    "usilampatti": "Usilampatti", "vadipatti": "Vadipatti", "vadippatti": "Vadipatti", "peraiyur": "Peraiyur", "kallikudi": "Kallikudi", "kalligudi": "Kallikudi",
}

#: Words of questions (fixed values): days back, weeks and months from the current one, month names.
DAY_WORDS = {"today": 0, "இன்று": 0, "yesterday": 1, "நேற்று": 1, "நேற்றை": 1, "tomorrow": -1, "நாளை": -1}
WEEK_WORDS = {"this week": 0, "current week": 0, "இந்த வாரம்": 0, "last week": -1, "previous week": -1, "கடந்த வாரம்": -1}
MONTH_WORDS = {"this month": 0, "current month": 0, "இந்த மாதம்": 0, "last month": -1, "previous month": -1, "கடந்த மாதம்": -1}
MONTH_NAMES = "january february march april may june july august september october november december".split()
