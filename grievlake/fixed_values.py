"""Values fixed by the data contract: word lists, lookup rows, formats and message templates.

Nothing here is logic. Every value below must stay exactly as it is for results to agree.
"""

from __future__ import annotations

# --- fixed values: sentinels and enumerations -------------------------------------------------
UNKNOWN = "UNKNOWN"
OTHER_ISSUE = "OTHER"
SENTINEL_PINCODE = "000000"
THREAT_LEVELS = ["LOW", "MEDIUM", "HIGH"]

# --- fixed values: scores, colours, coordinates, file types -----------------------------------
THREAT_SCORE = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
URGENCY_STEPS = [(8, "CRITICAL"), (5, "HIGH"), (3, "MEDIUM")]
URGENCY_FLOOR = "LOW"
URGENCY_COLOR = {"CRITICAL": "#e74c3c", "HIGH": "#e8622a", "MEDIUM": "#f39c12", "LOW": "#2ecc71"}
DEFAULT_COLOR = "#f39c12"
URGENCY_BADGE = {"CRITICAL": "badge-red", "HIGH": "badge-orange", "MEDIUM": "badge-yellow", "LOW": "badge-green"}
DEFAULT_BADGE = "badge-yellow"
PINCODE_COORDINATES = {
    "400053": (19.0760, 72.8777),
    "411001": (18.5204, 73.8567),
    "110001": (28.6139, 77.2090),
    "600001": (13.0827, 80.2707),
    "500001": (17.3850, 78.4867),
    "380001": (23.0225, 72.5714),
}
DEFAULT_COORDINATES = (20.5937, 78.9629)
AUDIO_GLOBS = ["mp3", "mp4", "wav", "m4a", "ogg"]
AUDIO_MIME = {
    "wav": "audio/wav", "mp3": "audio/mpeg", "ogg": "audio/ogg", "opus": "audio/opus",
    "m4a": "audio/mp4", "flac": "audio/flac", "aac": "audio/aac", "webm": "audio/webm", "amr": "audio/amr",
}
DEFAULT_MIME = "audio/wav"
RADAR_RENAMES = {
    "contractor": "contractor_name",
    "complaint_count": "total_complaints",
    "issue": "primary_issue",
    "score": "severity_score",
}

# --- fixed values: words that mark a welfare scheme as labour related --------------------------
LABOUR_KEYWORDS = [
    "labour", "worker", "wage", "unorganis", "construction",
    "shram", "mazdoor", "pension", "maternity", "bocw",
]

# --- fixed values: statute layout and chunk formats --------------------------------------------
SECTION_HEADER = r"(Section\s+)?(\d{1,3})\.\s+([A-Z][^\n]{5,80})\n"
SECTION_STOP = r"(?:Section\s+)?\d{1,3}\.\s+[A-Z]"
SECTION_PREFIX = "BNS_"
SECTION_SOURCE = "BNS_2023"
SCHEME_SOURCE = "GOV_SCHEMES"
MIN_SECTION_BODY = 30
MIN_CHUNK = 50
CONTEXT_CHARS = 300

# --- fixed values: statutory sections that fill gaps in a parsed corpus -------------------------
SEED_SECTIONS = [
    ("115", "Voluntarily causing hurt",
     "Whoever does any act with the intention of thereby causing hurt to any person, or with the knowledge that he is likely thereby to cause hurt to any person, and does thereby cause hurt to any person, is said to voluntarily cause hurt. Punishment: imprisonment up to 1 year or fine up to 10,000 rupees or both."),
    ("127", "Wrongful confinement",
     "Whoever wrongfully restrains any person in such a manner as to prevent that person from proceeding beyond certain circumscribing limits, is said wrongfully to confine that person. Punishment: imprisonment up to 1 year or fine up to 5,000 rupees or both."),
    ("143", "Unlawful compulsory labour",
     "Whoever unlawfully compels any person to labour against the will of that person shall be subject to imprisonment of either description for a term which may extend to one year, or with fine, or with both."),
    ("316", "Criminal breach of trust",
     "Whoever, being in any manner entrusted with property, or with any dominion over property, dishonestly misappropriates or converts to his own use that property, or dishonestly uses or disposes of that property in violation of any direction of law, is said to commit criminal breach of trust. Punishment: imprisonment up to 3 years or fine or both."),
    ("318", "Cheating",
     "Whoever, by deceiving any person, fraudulently or dishonestly induces the person so deceived to deliver any property to any person, or to consent that any person shall retain any property, or intentionally induces the person so deceived to do or omit to do anything which he would not do or omit if he were not so deceived, and which act or omission causes or is likely to cause damage or harm to that person, is said to cheat. Punishment: imprisonment up to 3 years or fine or both."),
    ("351", "Criminal intimidation",
     "Whoever threatens another with any injury to his person, reputation or property, or to the person or reputation of any one in whom that person is interested, with intent to cause alarm to that person, or to cause that person to do any act which he is not legally bound to do, or to omit to do any act which that person is legally entitled to do, as the means of avoiding the execution of such threat, commits criminal intimidation. Punishment: imprisonment up to 2 years or fine or both."),
]

# --- fixed values: advice per issue (sections, steps, portal, urgency) --------------------------
DEFAULT_ADVICE_ISSUE = "Wage Theft"
ADVICE = {
    "Wage Theft": (
        ["BNS Section 316 - Criminal Breach of Trust", "BNS Section 318 - Cheating"],
        ["File a written complaint at the nearest Labour Commissioner office.",
         "Cite BNS Section 316 (Criminal Breach of Trust) in your complaint.",
         "Register on eShram portal to access emergency state relief funds."],
        "shramsuvidha.gov.in or call helpline 14434", "HIGH"),
    "Physical Assault": (
        ["BNS Section 115 - Voluntarily Causing Hurt", "BNS Section 351 - Criminal Intimidation"],
        ["File an FIR immediately at the nearest police station.",
         "Cite BNS Section 115 (Voluntarily Causing Hurt) in the FIR.",
         "Contact the local Labour Union for witness support."],
        "police.gov.in or nearest police station", "HIGH"),
    "Wrongful Termination": (
        ["BNS Section 316 - Criminal Breach of Trust"],
        ["Obtain a written termination letter from employer (if not given, note it).",
         "File a complaint with the Labour Commissioner under the Industrial Disputes Act.",
         "Check eligibility for ESIC benefits at esic.nic.in."],
        "esic.nic.in or Labour Commissioner office", "MEDIUM"),
    "Forced Labour": (
        ["BNS Section 143 - Unlawful Compulsory Labour"],
        ["Contact the District Magistrate immediately — this is a cognisable offence.",
         "Cite BNS Section 143 (Unlawful Compulsory Labour) in your complaint.",
         "Reach out to the nearest anti-trafficking helpline: 1800-419-8588."],
        "nhrc.nic.in or call 1800-419-8588", "HIGH"),
    "Criminal Intimidation": (
        ["BNS Section 351 - Criminal Intimidation"],
        ["File an FIR at the nearest police station immediately.",
         "Cite BNS Section 351 (Criminal Intimidation) in the complaint.",
         "Request police protection if threat is ongoing."],
        "police.gov.in or nearest police station", "HIGH"),
}

# --- fixed values: advice when a reply cannot be used (batch and portal wording) ----------------
GENERIC_ADVICE = {
    "batch": (
        ["BNS Section 351", "BNS Section 316"],
        ["File an FIR at your nearest police station citing criminal intimidation.",
         "Contact the Labour Commissioner's office with wage proof.",
         "Register on eShram portal for emergency state relief."],
        "shramsuvidha.gov.in or call 14434"),
    "portal": (
        ["BNS Section 351 - Criminal Intimidation", "BNS Section 316 - Criminal Breach of Trust"],
        ["File an FIR at your nearest police station.",
         "Visit the Labour Commissioner with wage proof.",
         "Register on eShram portal for emergency relief."],
        "shramsuvidha.gov.in or call 14434"),
}
REQUIRED_ACTION_FIELDS = ["mode", "urgency", "bns_sections_cited", "action_steps", "government_portal"]

# --- fixed values: request and notice templates ({name} marks a column) -------------------------
RETRIEVAL_QUERY = "{issue_type} worker rights India {threat_level} threat"
ENTITY_PROMPT = """Extract entities from this labor complaint and return ONLY a JSON object.

Complaint: {english_text}

Return exactly this structure:
{{"contractor_name":"name mentioned or UNKNOWN","work_site":"location mentioned or UNKNOWN","issue_type":"one of WAGE_THEFT/PHYSICAL_ASSAULT/WRONGFUL_TERMINATION/UNSAFE_CONDITIONS/OTHER","violence_threatened":true or false,"worker_count_mentioned":number or 0}}"""
ACTION_PROMPT = """You are a legal aid expert for Indian unorganised labour law.

A worker has reported:
- Issue: {issue_type}
- Threat Level: {threat_level}

Relevant laws:
{context}

Respond ONLY in this exact JSON format, nothing else:
{{
  "bns_sections_cited": ["Section X", "Section Y"],
  "action_steps": ["Step 1: ...", "Step 2: ...", "Step 3: ..."],
  "government_portal": "portal name or URL",
  "urgency": "HIGH or MEDIUM or LOW"
}}"""
HINDI_PROMPT = """Translate the following legal advice to simple Hindi.
Use plain language that an uneducated daily wage worker can understand.
Do not add any explanation — output only the Hindi translation.

Text: {english_text}"""
TRANSLATION_PROMPT = """Translate this legal advice to {language}.
Use simple words that an uneducated daily-wage worker can understand.
Output ONLY the {language} translation, nothing else.

Text: {english_text}"""
NOTICE_PROMPT = """You are a Municipal Labour Officer drafting an official notice.

Facts:
- Contractor Name: {contractor_name}
- Area Pincode: {pincode}
- Number of Worker Complaints in 48 hours: {total_complaints}
- Primary Violation: {primary_issue}

Draft a formal Show Cause Notice in 150 words citing:
1. The relevant BNS 2023 section
2. The Code on Wages 2019
3. A 7-day deadline to respond

Use official government letter language."""
SHORT_NOTICE = """SHOW CAUSE NOTICE
To: Contractor {contractor_name}, Pincode {pincode}
This office has received {total_complaints} complaints of {primary_issue}.
You are directed to appear before the Labour Commissioner within 7 days.
Failure to comply will result in action under BNS Section 316 and Code on Wages 2019.
Issued by: Municipal Labour Enforcement Cell"""
LONG_NOTICE = """SHOW CAUSE NOTICE
━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━
To: Contractor {contractor_name}
Pincode: {pincode}

This office has received {total_complaints} complaints of
{primary_issue} against you in the past 48 hours.

You are directed to appear before the Labour Commissioner
within 7 days of receipt of this notice.

Failure to comply will result in action under:
• BNS Section 316 (Criminal Breach of Trust)
• Code on Wages, 2019

Issued by: Municipal Labour Enforcement Cell
━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━━"""

# --- fixed values: sample rows for a dashboard without data -------------------------------------
# contractor_name, pincode, lat, lon, total_complaints, severity_score, primary_issue
DEMO_RADAR = [
    ("Suresh Patil", "400053", 19.076, 72.877, 15, 9.5, "Wage Theft"),
    ("Rajesh Kumar", "411001", 18.520, 73.856, 11, 7.8, "Wage Theft"),
    ("Vikram Singh", "110001", 28.613, 77.209, 8, 6.2, "Forced Labour"),
    ("Mohan Das", "600001", 13.082, 80.270, 6, 5.1, "Criminal Intimidation"),
    ("Arun Sharma", "500001", 17.385, 78.486, 4, 3.3, "Wrongful Termination"),
    ("Suresh Patil", "380001", 23.022, 72.571, 3, 2.8, "Wage Theft"),
]
# issue_type, threat_label, contractor_name, pincode, complaint_count
DEMO_SCENARIOS = [
    ("Wage Theft", "HIGH", "Suresh", "400053", 15),
    ("Physical Assault", "HIGH", "Ramesh", "110001", 8),
    ("Wrongful Termination", "MEDIUM", "Vijay", "560001", 5),
    ("Forced Labour", "HIGH", "Mohan", "700001", 12),
]
