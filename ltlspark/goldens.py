"""Formulas with the texts that must come of them, for the queries' SQL and the tests.

Fixed values, written down from the published rules rather than computed here: negation normal
form, expansion, flattening, one step of distribution, sorted operands; prefix keys; printing by
precedence; controlled English; pattern classes.
"""

from __future__ import annotations

# Formula, key, key as first published (operands of every operator sorted, no separators).
KEYS = [
    (r"G(p)", r"G(p)", r"G(p)"),
    (r"!q W p", r"W(\neg(q),p)", r"W(\neg(q)p)"),
    (r"p U q", r"U(p,q)", r"U(pq)"),
    (r"q U p", r"U(q,p)", r"U(pq)"),
    (r"q R p", r"R(q,p)", r"R(pq)"),
    (r"G(p -> F(q))", r"G(\rightarrow(p,F(q)))", r"G(\rightarrow(F(q)p))"),
    (r"G(send -> X(F(receive)))", r"G(\rightarrow(send,X(F(receive))))", r"G(\rightarrow(X(F(receive))send))"),
    (r"!(p & q)", r"\neg(\land(p,q))", r"\neg(\land(pq))"),
    (r"!(p U (q | r))", r"\neg(U(p,\lor(q,r)))", r"\neg(U(\lor(qr)p))"),
    (r"q <-> p", r"\leftrightarrow(p,q)", r"\leftrightarrow(pq)"),
    (r"p M q", r"M(p,q)", r"M(pq)"),
    (r"!(p W q)", r"\neg(W(p,q))", r"\neg(W(pq))"),
    (r"r & q & p", r"\land(p,q,r)", r"\land(pqr)"),
    (r"p & (q | (r & s))", r"\land(\lor(\land(r,s),q),p)", r"\land(\lor(\land(rs)q)p)"),
    (r"X(1) | p", r"\lor(X(true),p)", r"\lor(X(true)p)"),
    (r"p -> (q -> r)", r"\rightarrow(p,\rightarrow(q,r))", r"\rightarrow(\rightarrow(qr)p)"),
    (r"((a U b) R (c M d)) <-> !(X(G(e)))", r"\leftrightarrow(R(U(a,b),M(c,d)),\neg(X(G(e))))", r"\leftrightarrow(R(M(cd)U(ab))\neg(X(G(e))))"),
    (r"G(!(F(!(X(p & !q)))) | (r U (s W t)))", r"G(\lor(U(r,W(s,t)),\neg(F(\neg(X(\land(\neg(q),p)))))))", r"G(\lor(U(W(st)r)\neg(F(\neg(X(\land(\neg(q)p)))))))"),
    (r"p -> 0", r"\rightarrow(p,false)", r"\rightarrow(falsep)"),
]

# Formula, the key of its normal form, the same as first published. Their sha-256 are the canonical hashes.
NORMAL = [
    (r"G(p)", r"G(p)", r"G(p)"),
    (r"!q W p", r"R(p,\lor(\neg(q),p))", r"W(\neg(q)p)"),
    (r"G(p -> F(q))", r"G(\lor(F(q),\neg(p)))", r"G(\lor(F(q)\neg(p)))"),
    (r"!(p & q)", r"\lor(\neg(p),\neg(q))", r"\lor(\neg(p)\neg(q))"),
    (r"!(p U (q | r))", r"R(\neg(p),\land(\neg(q),\neg(r)))", r"R(\land(\neg(q)\neg(r))\neg(p))"),
    (r"p <-> q", r"\land(\lor(\neg(p),q),\lor(\neg(q),p))", r"\land(\lor(\neg(p)q)\lor(\neg(q)p))"),
    (r"!(p <-> q)", r"\lor(\land(\neg(p),q),\land(\neg(q),p))", r"\neg(\land(\lor(\neg(p)q)\lor(\neg(q)p)))"),
    (r"p M q", r"U(q,\land(p,q))", r"M(pq)"),
    (r"!(p W q)", r"U(\neg(q),\land(\neg(p),\neg(q)))", r"\neg(W(pq))"),
    (r"p & (q | (r & s))", r"\land(\lor(\land(r,s),q),p)", r"\land(\land(\lor(qr)\lor(qs))p)"),
    (r"p -> (q -> r)", r"\lor(\neg(p),\neg(q),r)", r"\lor(\neg(p)\neg(q)r)"),
    (r"!!p", r"p", r"\neg(\neg(p))"),
    (r"!(G(F(p)))", r"F(G(\neg(p)))", r"F(G(\neg(p)))"),
    (r"!(X(p) R 1)", r"U(X(\neg(p)),false)", r"U(X(\neg(p))\neg(true))"),
    (r"((a U b) R (c M d)) <-> !(X(G(e)))", r"\land(\lor(R(U(a,b),U(d,\land(c,d))),X(G(e))),\lor(U(R(\neg(a),\neg(b)),R(\neg(d),\lor(\neg(c),\neg(d)))),X(F(\neg(e)))))", r"\land(\lor(R(M(cd)U(ab))\neg(X(F(\neg(e)))))\lor(X(F(\neg(e)))\neg(R(M(cd)U(ab)))))"),
]

# Formula, published LaTeX (brackets where an operand binds less tightly), controlled English, negation normal
# form as text, and the tree as it prints itself.
TEXTS = [
    (r"G(p)", r"G {p}", "Always, p", "G(p)", "always(p)"),
    (r"!q W p", r"\left(\neg {q}\right) W p", "not q weakly until p", "(p R (!q | p))", "(not(q) weak_until p)"),
    (r"G(p -> F(q))", r"G {p \rightarrow F {q}}", "Always, if p, then Eventually, q", "G((!p | F(q)))", "always((p implies eventually(q)))"),
    (r"!(p U (q | r))", r"\neg {p U \left(q \lor r\right)}", "not p until q or r", "(!p R (!q & !r))", "not((p until (q or r)))"),
    (r"p <-> !q", r"p \leftrightarrow \neg {q}", "p if and only if not q", "((!p | !q) & (q | p))", "(p iff not(q))"),
    (r"!(p M (q & r))", r"\neg {p M \left(q \land r\right)}", "not p strong release q and r", "((!q | !r) R (!p | (!q | !r)))", "not((p strong_release (q and r)))"),
    (r"X(1) | !(p W q)", r"X {true} \lor \neg {p W q}", "In the next state, true or not p weakly until q", "(X(true) | (!q U (!p & !q)))", "(next(true) or not((p weak_until q)))"),
    (r"F(G(p)) & !(q R r)", r"F {G {p}} \land \neg {q R r}", "Eventually, Always, p and not q releases r", "(F(G(p)) & (!q U !r))", "(eventually(always(p)) and not((q release r)))"),
    (r"(p | q) & (p | q)", r"\left(p \lor q\right) \land \left(p \lor q\right)", "p or q and p or q", "((p | q) & (p | q))", "((p or q) and (p or q))"),
    (r"p & (q | (r & s))", r"p \land \left(q \lor r \land s\right)", "p and q or r and s", "(p & (q | (r & s)))", "(p and (q or (r and s)))"),
    (r"p -> (q -> r)", r"p \rightarrow q \rightarrow r", "if p, then if q, then r", "(!p | (!q | r))", "(p implies (q implies r))"),
    (r"(p <-> q) -> r", r"\left(p \leftrightarrow q\right) \rightarrow r", "if p if and only if q, then r", "(((p & !q) | (q & !p)) | r)", "((p iff q) implies r)"),
    (r"(q U p) & (p U q)", r"q U p \land p U q", "q until p and p until q", "((q U p) & (p U q))", "((q until p) and (p until q))"),
    (r"((a U b) R (c M d)) <-> !(X(G(e)))", r"a U b R c M d \leftrightarrow \neg {X {G {e}}}", "a until b releases c strong release d if and only if not In the next state, Always, e", "((((!a R !b) U (!d R (!c | !d))) | X(F(!e))) & (X(G(e)) | ((a U b) R (d U (c & d)))))", "(((a until b) release (c strong_release d)) iff not(next(always(e))))"),
    (r"G(!(F(!(X(p & !q)))) | (r U (s W t)))", r"G {\neg {F {\neg {X {p \land \neg {q}}}}} \lor r U s W t}", "Always, not Eventually, not In the next state, p and not q or r until s weakly until t", "G((G(X((p & !q))) | (r U (t R (s | t)))))", "always((not(eventually(not(next((p and not(q)))))) or (r until (s weak_until t))))"),
]

# Controlled English and the formula that it reads back as, binary operands in parentheses.
BACK = [
    ("Always, p", "G(p)"),
    ("Eventually, q", "F(q)"),
    ("In the next state, r", "X(r)"),
    ("p until q", "(p) U (q)"),
    ("p releases q", "(p) R (q)"),
    ("p weakly until q", "(p) W (q)"),
    ("Always, if p, then Eventually, q", "G((p) -> (F(q)))"),
    ("not q weakly until p", "!((q) W (p))"),
    ("Always, not p", "G(!(p))"),
    ("Always, Eventually, p", "G(F(p))"),
    ("Eventually, Always, p", "F(G(p))"),
    ("Always, p and q", "G((p) & (q))"),
    ("Eventually, p or q", "F((p) | (q))"),
    ("Always, if request, then Eventually, acknowledge", "G((request) -> (F(acknowledge)))"),
    ("Always, if try, then Eventually, success or Always, failure", "G((try) -> (F((success) | (G(failure)))))"),
    ("Always, if send, then In the next state, Eventually, receive", "G((send) -> (X(F(receive))))"),
    ("Always, if alarm, then alarm until reset", "G((alarm) -> ((alarm) U (reset)))"),
]

# Texts of propositions and what is left of them.
ATOMS = [("the condition p holds", "p"), ("q is true, r", "q"), ("TRUE", "true"), ("Falsehood", "false"), ("the system", "the system"), (" ,request; ", "request"), ("is met", "")]

# Two formulas, insertions, deletions and changes between their trees, and the larger tree's nodes.
DISTANCES = [
    ("G(p)", "!F(!p)", 3, 4),
    ("F(p | q)", "F(p) | F(q)", 3, 5),
    ("G(p | q)", "G(p) | G(q)", 3, 5),
    ("p W q", "(p U q) | G(p)", 4, 6),
    ("p R q", "!(!p U !q)", 4, 6),
    ("F(G(p))", "G(F(p))", 2, 3),
    ("p U (q U q)", "p U q", 2, 5),
    ("X(p & q)", "X(p) & X(q)", 3, 5),
    ("p M q", "q U (p & q)", 3, 5),
    ("p & q & r", "p & r & q", 2, 4),
    ("p", "p", 0, 1),
    ("p ->", "p", None, 1),
]

# Formula, and its text after one step each: negation normal form, expansion of implications, flattening,
# one step of distribution, sorted operands, simplification.
REWRITES = [
    ("!(p -> q)", "p & !q", "!(!p | q)", "!(p -> q)", "!(p -> q)", "!(p -> q)", "!(p -> q)"),
    ("p <-> q", "(!p | q) & (!q | p)", "(!p | q) & (!q | p)", "p <-> q", "p <-> q", "p <-> q", "p <-> q"),
    ("!(G(p) & F(q))", "F(!p) | G(!q)", "!(G(p) & F(q))", "!(G(p) & F(q))", "!(G(p) & F(q))", "!(F(q) & G(p))", "!(F(q) & G(p))"),
    ("p & (q & r)", "p & (q & r)", "p & (q & r)", "p & q & r", "p & (q & r)", "(q & r) & p", "p & q & r"),
    ("p | (q & r)", "p | (q & r)", "p | (q & r)", "p | (q & r)", "(q | p) & (r | p)", "(q & r) | p", "(q & r) | p"),
    ("(p W q) & true", "(q R (p | q)) & true", "(p W q) & true", "(p W q) & true", "(p W q) & true", "(p W q) & true", "p W q"),
    ("r | q | p", "r | q | p", "r | q | p", "r | q | p", "r | q | p", "p | q | r", "p | q | r"),
    ("G(G(p)) | 0", "G(G(p)) | false", "G(G(p)) | false", "G(G(p)) | false", "G(G(p)) | false", "G(G(p)) | false", "G(p)"),
    ("!(p U !q)", "!p R q", "!(p U !q)", "!(p U !q)", "!(p U !q)", "!(p U !q)", "!(p U !q)"),
    ("X(p) & !X(p)", "X(p) & X(!p)", "X(p) & !X(p)", "X(p) & !X(p)", "X(p) & !X(p)", "X(p) & !X(p)", "false"),
]

# Formula, English, what it reads back as, verdict and message.
CHECKS = [
    ("F(p)", "Always, p", "G(p)", False, "ITL 'Always, p' translates to 'G(p)' which is not equivalent to 'F(p)'"),
    ("G(p)", "Error generating ITL: bad", None, False, "Error generating ITL: bad"),
    ("p", "", None, False, "Failed to parse ITL"),
    ("!q W p", "not q weakly until p", "!((q) W (p))", False, "ITL 'not q weakly until p' translates to '!((q) W (p))' which is not equivalent to '!q W p'"),
    ("G(p)", "At all times, p", "G(p)", True, None),
    ("p -> q", "p ensures q", "(p) -> (q)", True, None),
    ("p <-> q", "q holds exactly when p", "(q) <-> (p)", True, None),
]

# A converted column's text before, and after it is checked again with its canonical form ("kept" where the row is left alone).
REVALIDATED = [
    ("G(p)", "G(p)", "G(p)"),
    ("q | p", "q | p", "p | q"),
    ("p & p", "p & p", "p"),
    ("p &", "ERROR: p &", "ERROR"),
    ("ERROR: no formula", "ERROR: no formula", "kept"),
    (None, None, "kept"),
    ("F(F(q)) & true", "F(F(q)) & true", "F(q)"),
]

# Golden formulas with their pattern class and the operands that its sentences name.
OPERANDS = [
    ("G(p)", "invariance", "p", None),
    ("F(q)", "eventuality", "q", None),
    ("p U q", "until", "p", "q"),
    ("p R q", "release", "p", "q"),
    ("G(p -> F(q))", "response", "p", "q"),
    ("!q W p", "precedence", "q", "p"),
    ("G(!p)", "invariance", "not(p)", None),
    ("G(F(p))", "reactivity", "p", None),
    ("F(G(p))", "stability", "p", None),
    ("G(p & q)", "invariance", "(p and q)", None),
    ("F(p | q)", "eventuality", "(p or q)", None),
    ("G(request -> F(acknowledge))", "response", "request", "acknowledge"),
    ("G(try -> F(success | G(failure)))", "response", "try", "(success or always(failure))"),
    ("G(send -> X(F(receive)))", "invariance", "(send implies next(eventually(receive)))", None),
    ("G(alarm -> (alarm U reset))", "invariance", "(alarm implies (alarm until reset))", None),
]

# LaTeX-like formulas, their reading or the error, and how it came about.
CONVERTED = [
    (r"u \land \neg {G {\neg {\neg {w \leftrightarrow s}}} U u} \lor s", "(u & !(G(!!(w <-> s)) U u)) | s", "valid"),
    (r"G {p} \land F {\neg {p}}", "G(p) & F(!p)", "valid"),
    (r"p \lor \neg {p}", "p | !p", "valid"),
    (r"p \rightarrow (q \lor r)", "p -> (q | r)", "valid"),
    (r"\neg {\neg {p}} \leftrightarrow p", "!!p <-> p", "valid"),
    (r"G {F {p}} \rightarrow F {G {p}}", "G(F(p)) -> F(G(p))", "valid"),
    (r"p U (q U r)", "p U (q U r)", "valid"),
    (r"(p U q) U r", "(p U q) U r", "valid"),
    (r"\neg {G {p}} \leftrightarrow F {\neg {p}}", "!G(p) <-> F(!p)", "valid"),
    (r"(G (p \rightarrow F q)) \land (G (r \rightarrow F s))", "G(p -> F(q)) & G(r -> F(s))", "valid"),
    (r"G (p \rightarrow (q U r)) \lor (s U (\neg {t}))", "G(p -> (q U r)) | (s U !t)", "valid"),
    (r"\neg{(p U q) R (r M s)}", "!((p U q) R (r M s))", "valid"),
    (r"G (p \rightarrow (F q \land X (r \lor s)))", "G(p -> (F(q) & X(r | s)))", "valid"),
    (r"F G ((p \lor q) \land (r -> s))", "F(G((p | q) & (r -> s)))", "valid"),
    (r"\left(p \land q\right) U r", "(p & q) U r", "valid"),
    (r"p \land q \land r", "p & q & r", "valid"),
    (r"p \land", "ERROR: unexpected end", "error"),
    (r"p q", "ERROR: unexpected 'q'", "error"),
    (r"", "ERROR: empty formula", "error"),
]
