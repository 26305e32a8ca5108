"""Fixed word lists and weights. These values decide results and must not be tuned."""

# Words that carry no signal for lexical search.
SEARCH_STOP_WORDS = """
a an the of in on for and or to with is are was were be been being am
what which who whom whose when where why how does do did can could should would will shall
explain define describe state give list write mean meant means tell about between into by
that this these those it its as at from
""".split()

# Words ignored when checking that produced text is grounded in its sources.
GROUNDING_STOP_WORDS = sorted(set("""
a an the of in on for and or to with is are was were be been being am it its as at from by
this that these those there here then thus therefore hence so such which who whom whose what when where
why how we you they he she our your their his her them us can could should would will shall may
might must do does did has have had not no yes if but also into about over under than very just
each any all some more most one two
important note example performed start follows begin additionally suppose consider however
straightforward learn different ways manipulate help understand applications better details refer
source since well now let given find want look analyze case above below following next previous
first second third finally lastly often sometimes always never cannot ought need needs needed
""".split()))

# Words dropped when a query or a name is turned into a lookup key.
LOOKUP_STOP_WORDS = """
a an the of in on for and or to with is are was were be what which how does do did
that this between difference explain define why
""".split()

# Words ignored when an answer is compared with its sources.
ANSWER_COMMON_WORDS = """
the a an is are was were be been have has had do does did will would could should may might can
to of in for on with at by from as into this that these those it its they them we our you your i my
not no but and or if then so also very more most some any all each every both
""".split()

# Words counted in the stop-word share of a concept name.
NAME_STOP_WORDS = """
the and a to of in i is that it on you this for but with are have be at or as was so if out not we
can they by what how why which there their will would from when an then
""".split()

# Suffixes whose last two letters go when a plural is folded.
PLURAL_ES_SUFFIXES = ["sses", "shes", "ches", "xes", "zes", "ses"]

# Field weights and saturation of the lexical score.
FIELD_WEIGHTS = {"name": 3.0, "alias": 2.5, "definition": 1.0, "example": 0.5}
BM25_K1 = 1.5
BM25_B = 0.75
EXACT_NAME_BOOST = 1000.0
EXACT_ALIAS_BOOST = 500.0
NAME_SUPERSET_BOOST = 100.0

# Words removed from concept names, and names that are never concepts.
NAME_FILLER_WORDS = "the a an of in on for and to with".split()
NAME_BLOCKLIST = [
    "introduction", "summary", "conclusion", "preface", "objective", "overview", "solution",
    "answer", "answers", "notes", "miscellaneous", "appendix", "appendices", "bibliography",
    "references", "exercises", "exercise", "all rights reserved", "copyright", "contents", "index",
    "chapter", "part", "mathematics", "physics", "chemistry", "biology", "science", "unit", "topic",
    "formula",
]
INSTRUCTION_WORDS = (
    "describe state explain distinguish calculate predict discuss determine find write show give define"
).split()
SENTENCE_OPENERS = "if thus here therefore hence when where".split()
SENTENCE_VERBS = """
is are was were be been being have has had does do did can could should would may might must
depend depends know stand means occur occurs affected increase decrease contains follow get
""".split()

# Content words and the aliases they suggest for a concept that talks about them.
CONTENT_ALIASES = {
    "young": ["young double slit", "young's double slit experiment"],
    "double slit": ["double slit", "young double slit"],
    "fringe width": ["fringe width"],
    "interference fringes": ["interference fringes"],
    "diffraction": ["diffraction"],
    "polarization": ["polarization", "polarisation"],
    "gauss's law": ["gauss's law"],
    "coulomb's law": ["coulomb's law"],
    "faraday's law": ["faraday's law"],
    "lenz's law": ["lenz's law"],
    "ampere's law": ["ampere's law"],
    "lorentz force": ["lorentz force"],
    "ohm's law": ["ohm's law"],
    "kirchhoff's laws": ["kirchhoff's laws"],
    "hall effect": ["hall effect"],
    "newton's laws": ["newton's laws"],
    "conservation of energy": ["conservation of energy"],
    "conservation of momentum": ["conservation of momentum"],
    "centripetal force": ["centripetal force"],
    "projectile motion": ["projectile motion"],
    "organic chemistry": ["organic chemistry"],
    "chemical reaction": ["chemical reaction"],
    "chemical equilibrium": ["chemical equilibrium"],
    "electrochemistry": ["electrochemistry"],
    "thermodynamics": ["thermodynamics"],
    "chemical kinetics": ["chemical kinetics"],
    "matrix multiplication": ["matrix multiplication"],
    "matrix addition": ["matrix addition"],
    "matrix inverse": ["matrix inverse"],
    "determinant": ["determinant"],
    "integration": ["integration", "integral"],
    "differentiation": ["differentiation", "derivative"],
    "partial fractions": ["partial fractions"],
    "probability": ["probability"],
    "vectors": ["vectors"],
}

# Subjects whose sources can ground an answer.
TAUGHT_SUBJECTS = ["mathematics", "physics", "chemistry"]
