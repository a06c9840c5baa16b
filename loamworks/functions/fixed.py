"""Word lists, patterns, ranks and scores that results depend on."""

# Acceptance columns and result columns of a grid, by substring of the header.
LIMIT_HEADERS = ("limit", "acceptance", "specification", "criteria", "spec")
RESULT_HEADERS = ("result", "observed", "found", "obtained")

# Elements that a method validation report has to cover, and the words for each.
VALIDATION_ELEMENTS = (
    ("specificity", ("specificity",)),
    ("linearity", ("linearity",)),
    ("limit of detection (LOD)", ("limit of detection", "lod")),
    ("limit of quantitation (LOQ)", ("limit of quantitation", "loq")),
    ("precision", ("precision", "repeatability")),
    ("accuracy / recovery", ("accuracy", "recovery")),
    ("robustness / ruggedness", ("robustness", "ruggedness")),
    ("system suitability", ("system suitability",)),
    ("solution stability", ("solution stability", "stability of standard", "stability of sample", "stability of analytical")),
)
VALIDATION_SECTIONS = ("3.2.S.4.2", "3.2.S.4.3", "3.2.P.4.2", "3.2.P.4.3")

# Components of a container closure, and what marks their coverage or a commitment.
COMPONENTS = ("backing film", "release liner", "pouch")
USP88 = r"<\s*88\s*>"
COMMITMENT = r"(?i)commit|continue\s+to\s+monitor|ongoing\s+monitor|monitor[a-z ]{0,30}shelf\s*life|monitor[a-z ]{0,30}through\s+the\s+proposed"
AET = r"(?iu)\baet\b[^\d]{0,45}?(\d+(?:\.\d+)?)\s*[µμu]?\s*g\s*/\s*(g|patch)"

# Section codes in order of priority.
CTD_SECTIONS = ("3.2.S.4.1", "3.2.S.4.2", "3.2.S.4.3", "3.2.S.4.4", "3.2.S.7", "3.2.P.4.1", "3.2.P.4.3", "3.2.P.5", "3.2.P.7", "3.2.P.3", "3.2.P.2")
UNKNOWN_SECTION = "unknown"

# Free-text types and the domain that each belongs to.
ALIASES = (
    ("specification/coa", "specification"),
    ("specification", "specification"),
    ("description/compostion", "specification"),
    ("method/valdn", "method-validation"),
    ("method/validation", "method-validation"),
    ("impurities", "impurities"),
    ("elemental impurities", "elemental-impurities"),
    ("stability", "stability"),
    ("dissolution", "dissolution"),
    ("in-vitro study", "dissolution"),
    ("be", "dissolution"),
    ("container/closure", "container-closure"),
    ("extractable / leachable", "container-closure"),
    ("leachable", "container-closure"),
    ("manufacturing process/ scale-up", "manufacturing-process"),
    ("in-process controls", "manufacturing-process"),
    ("administrative/ facilities", "manufacturing-process"),
    ("pdr-qbd (development report)", "development"),
    ("characterization/justification", "development"),
    ("excipients", "development"),
    ("anda batch/ reconciliation / 32r", "batch-data"),
)

# Words in a document that suggest a domain, and the domains where none do.
DOMAIN_HINTS = (
    ("method-validation", ("validation", "linearity", "precision", "specificity", "system suitability", "lod", "loq")),
    ("impurities", ("impurit", "related compound", "related substance")),
    ("elemental-impurities", ("elemental", "q3d", "metal")),
    ("residual-solvents", ("residual solvent", "q3c")),
    ("stability", ("stability",)),
    ("dissolution", ("dissolution", "ivrt", "in-vitro")),
    ("container-closure", ("leachable", "extractable", "container", "closure", "e&l", "e & l")),
    ("specification", ("specification", "acceptance criteria", "assay", "coa")),
)
DEFAULT_DOMAINS = ("specification", "method-validation", "impurities")
MOST_DOMAINS, MOST_CHALLENGES = 8, 20

# Ranks and scores of findings.
AUTHORITY = (("code_verified", 3), ("checklist", 2), ("quote_anchored", 1), ("model_judgment", 0))
TIERS = (("verified", 0), ("corroborated", 1), ("advisory", 2))
SEVERITIES = (("high", 0), ("medium", 1), ("low", 2))
SCORES = {("quote", True): 0.6, ("judgment", True): 0.5, ("quote", False): 0.4, ("judgment", False): 0.3}

# Prompt budgets in characters.
SECTION_BUDGET, PICKED_BUDGET, WIDE_BUDGET = 45_000, 16_000, 30_000

# Geometry, as multiples of the median line height or shares of the page.
HEADER_BAND, FOOTER_BAND = 0.12, 0.92
STITCH_EDGE, STITCH_BOTTOM, STITCH_TOP = 20.0, 0.80, 0.30
