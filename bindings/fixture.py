"""A taxonomy whose keywords are fragments of the test corpus, so that every rule has work to do."""

from __future__ import annotations

from vocspark.functions.gist import GistProfile
from vocspark.functions.sentiment import Lexicon
from vocspark.taxonomy import AudienceRules, Taxonomy, parse_categories, parse_groups

CATEGORIES = {
    "MAKE": {"name": "Making", "audience": "Developer", "subcategories": {
        "KIT": {"name": "Kit", "priority": "high", "feature_area": "Tools",
                "keywords": ["nsten", "rereti", "eedw", "ción", "onede"]},
        "CALLS": {"name": "Calls", "priority": "critical", "feature_area": "Interfaces",
                  "keywords": ["erono", "ereds", "THORT", "nwhe", "aned", "esti"]},
        "SHIP": {"name": "Ship", "priority": "medium", "feature_area": "Tools",
                 "keywords": ["thesly", "endin", "hndo"]}}},
    "USE": {"name": "Using", "audience": "Customer", "subcategories": {
        "SCREEN": {"name": "Screen", "priority": "medium", "feature_area": "Looks",
                   "keywords": ["zust", "lichk", "aulic", "chie", "keit"]},
        "REPORT": {"name": "Report", "priority": "high", "feature_area": "Reports",
                   "keywords": ["threed", "hatre", "shwh", "anha", "ingn", "ersh", "outi"]},
        "PRICE": {"name": "Price", "priority": "low", "feature_area": "Billing",
                  "keywords": ["iereux", "éier", "entre"]}}},
    "SERVE": {"name": "Service", "audience": "All", "subcategories": {
        "SPEED": {"name": "Speed", "priority": "critical", "feature_area": "Speed",
                  "keywords": ["bleing", "hheti", "shly", "whnt"]},
        "HELP": {"name": "Help", "priority": "low", "feature_area": "Support",
                 "keywords": ["oción", "zuhei", "none"]}}},
}
IMPACTS = {
    "BUG": {"name": "Bug", "keywords": ["lyer", "nkeit", "thste"]},
    "FEATURE_REQUEST": {"name": "Feature Request", "keywords": ["stes", "ionth", "hert", "ngon"]},
    "QUESTION": {"name": "Question", "keywords": ["enbe", "hore", "ción"]},
}
DOMAINS = {
    "LOGIN": {"name": "Login", "color": "#111111", "keywords": ["behei", "neal", "Ingan", "none"]},
    "LOOKS": {"name": "Looks", "color": "#222222", "keywords": ["tionvi", "houo", "nena"]},
    "RULES": {"name": "Rules", "color": "#333333", "keywords": ["erhee", "honn", "lichie"]},
    "START": {"name": "First Steps", "color": "#444444", "keywords": ["gelic", "mentre", "ando", "ionb"]},
}
LEGACY = {
    "WISH": {"name": "Wishes", "keywords": ["hhaan", "anmen"]},
    "SPEED": {"name": "Speed and stability", "keywords": ["anont", "Nornt", "éier"]},
    "LINK": {"name": "Connections", "keywords": ["stin", "nger"]},
}
AUDIENCES = {
    "Developer": ["ntione", "ingin", "rste", "ernt"],
    "Customer": ["nhet", "thwho", "resh", "zust", "enea"],
    "ISV": ["noro", "nthin", "éier"],
}
RULES = AudienceRules(
    portal_terms=("nbleon", "threed"), partner_terms=("hinn", "eedw", "lyer"), saas_terms=("hwhing", "fthea"))
KEYWORDS = ["Nthin", "sher", "chie", "tionvi", "zzzz", "éier"]

TAXONOMY = Taxonomy(
    subcategories=parse_categories(CATEGORIES), impact_types=parse_groups(IMPACTS), domains=parse_groups(DOMAINS),
    legacy_categories=parse_groups(LEGACY), audiences={k: tuple(v) for k, v in AUDIENCES.items()},
    tracked_keywords=tuple(KEYWORDS), rules=RULES)

LEXICON = Lexicon(
    entries={"the": (0.4, 0.3), "and": (-0.2, 0.5), "that": (-0.9, 0.7), "with": (0.85, 0.1), "une": (0.6, 0.6),
             "les": (-0.7, 0.2), "und": (0.3, 0.9), "der": (-0.55, 0.4), "que": (0.15, 0.8), "los": (-0.35, 0.25)},
    negators=("not", "is", "la"), boosters={"of": 1.3, "in": 1.5, "le": 0.5})

GIST = GistProfile(
    groups={"links": ("nsten", "ción"), "looks": ("thwho", "éier"), "speed-up": ("shly", "zust")},
    bonus_terms=("anha", "chie"),
    key_terms=(("that", "une", "und"), ("with", "los")))

SOURCES = ["Reddit", "GitHub Discussions", "GitHub Issues", "Azure DevOps", "Community Forum", "GitHub"]
SCENARIOS = ["Customer", "Partner", "Internal", ""]
ORGANIZATIONS = ["GitHub/acme", "Vendor One", "ADO/core", "Acme", ""]
