"""Schemas of the corpus' tables, the domains, and golden formulas."""

from __future__ import annotations

# The columns of the corpus' tables.
AST = "array<struct<k:string,a:int,v:string>>"
FORMULAS = "id bigint not null, formula string not null, latex string not null, canonical_hash string not null, depth int not null, spot_formulas string, canonical_form string"
ITL = "id bigint not null, formula_id bigint not null, itl_text string not null, canonical_form boolean not null, generation_method string not null, verified boolean, is_correct boolean, verification_errors string"
TRANSLATIONS = "id bigint not null, formula_id bigint not null, itl_id bigint not null, domain string not null, activity string not null, translation string not null, generation_time double, timestamp timestamp, worker_id int"
DOMAIN_STATS = "id bigint not null, domain string, count bigint"
RESULTS = "id bigint not null, formula_id bigint not null, itl_id bigint not null, translation_id bigint not null, is_correct boolean, score int, issues array<string>, reasoning string, verification_time double, verification_timestamp timestamp"
STATISTICS = "id bigint not null, timestamp string, total_entries bigint, total_verified bigint, correct_percentage double, incorrect_percentage double, average_score double, median_score double, average_time double, statistics_json string"
EXPORT = "formula_id bigint, formula string, latex string, formula_canonical_form string, depth bigint, itl_id bigint, itl_text string, generation_method string, verified bigint, is_correct bigint, translation_id bigint, domain string, activity string, translation string, generation_time double"
PREDICTIONS = "task string, variant string, item_id bigint, prediction string, reference string, source_text string, domain string, depth int, operators int, propositions int"
TABLES = {"formulas": FORMULAS, "itl_representations": ITL, "nl_translations": TRANSLATIONS, "domain_stats": DOMAIN_STATS, "verification_results": RESULTS, "verification_statistics": STATISTICS}

# The domains, in order.
DOMAINS = [
    "Home Automation",
    "Robotics",
    "Automotive/Autonomous Vehicles",
    "Aerospace",
    "Medical Devices",
    "Industrial Automation/Manufacturing",
    "Networking/Distributed Systems",
    "Financial/Transaction Systems",
    "Web Services/APIs",
    "Smart Grid/Energy Management",
    "Build Pipelines and CI/CD",
    "Version Control and Code Reviews",
    "Security and Authentication",
]

# Formula, canonical English, paraphrase.
GOLDEN = [
    ("G(p)", "Always, p", "Always, p"),
    ("G(p)", "Always, p", "At all times, p holds"),
    ("G(p)", "Always, p", "It is invariably the case that p is true"),
    ("F(q)", "Eventually, q", "Eventually, q"),
    ("F(q)", "Eventually, q", "At some point, q will be true"),
    ("F(q)", "Eventually, q", "Ultimately, q holds"),
    ("X(r)", "In the next state, r", "In the next state, r"),
    ("X(r)", "In the next state, r", "Immediately after this, r holds"),
    ("p U q", "p until q", "p until q"),
    ("p U q", "p until q", "p holds until q becomes true"),
    ("p R q", "p releases q", "p releases q"),
    ("p R q", "p releases q", "q holds until and including the point where p holds"),
    ("p W q", "p weakly until q", "p weakly until q"),
    ("p W q", "p weakly until q", "Either p holds forever or p holds until q"),
    ("G(p -> F(q))", "Always, if p, then Eventually, q", "Always, if p, then Eventually, q"),
    ("G(p -> F(q))", "Always, if p, then Eventually, q", "Whenever p holds, q will eventually be true"),
    ("G(p -> F(q))", "Always, if p, then Eventually, q", "Every occurrence of p is followed by an occurrence of q"),
    ("!q W p", "not q weakly until p", "not q weakly until p"),
    ("!q W p", "not q weakly until p", "q never occurs before p"),
    ("G(!p)", "Always, not p", "Always, not p"),
    ("G(!p)", "Always, not p", "p never holds"),
    ("G(F(p))", "Always, Eventually, p", "Always, Eventually, p"),
    ("G(F(p))", "Always, Eventually, p", "It is always the case that p will eventually hold"),
    ("F(G(p))", "Eventually, Always, p", "Eventually, Always, p"),
    ("F(G(p))", "Eventually, Always, p", "Eventually, p will hold forever"),
    ("G(p & q)", "Always, p and q", "Always, both p and q hold"),
    ("F(p | q)", "Eventually, p or q", "Eventually, either p or q will be true"),
    ("G(request -> F(acknowledge))", "Always, if request, then Eventually, acknowledge", "Every request must be eventually acknowledged"),
    ("G(try -> F(success | G(failure)))", "Always, if try, then Eventually, success or Always, failure", "Every attempt either eventually succeeds or permanently fails"),
    ("G(send -> X(F(receive)))", "Always, if send, then In the next state, Eventually, receive", "Whenever a message is sent, it will start to be received in the next state"),
    ("G(alarm -> (alarm U reset))", "Always, if alarm, then alarm until reset", "Once triggered, an alarm continues until it is reset"),
]
