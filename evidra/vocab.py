"""Vocabularies and lookup dimensions.

Everything under a "Fixed values" comment is data that results depend on, kept as given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: relation predicates ---
COMPONENT_PREDICATES = {"solvent": "hasSolvent", "salt": "hasSalt", "additive": "hasAdditive"}
MOLECULE_PREDICATES = [
    "sameAs", "decomposesTo", "hasSolvent", "hasSalt",
    "usedWith", "coOccursWith", "increases", "decreases",
]
LINK_PREDICTION_PREDICATES = ["hasSolvent", "hasSalt", "hasAdditive", "increases", "decreases"]

# --- Fixed values: predicate, allowed subject types, allowed object types ---
RELATION_CONSTRAINTS = [
    ("hasSolvent", ["ElectrolyteFormulation"], ["Solvent"]),
    ("hasSalt", ["ElectrolyteFormulation"], ["Salt"]),
    ("hasAdditive", ["ElectrolyteFormulation"], ["Additive"]),
    ("hasMeasurement", ["ElectrolyteFormulation"], ["PropertyMeasurement"]),
    ("decomposesTo", ["Molecule"], ["InterphaseSpecies"]),
    ("increases", ["Additive", "Solvent", "Salt"], ["PropertyType"]),
    ("decreases", ["Additive", "Solvent", "Salt"], ["PropertyType"]),
    ("coOccursWith", ["Molecule"], ["Molecule"]),
]

# --- Fixed values: hypothesis life cycle and origin, curation outcomes ---
HYPOTHESIS_STATUSES = ["proposed", "under_evaluation", "validated", "rejected", "inconclusive"]
HYPOTHESIS_SOURCES = ["kg_embedding", "rule_mining", "gnn_completion", "abduction", "human", "llm"]
CURATION_OUTCOMES = ["approved", "rejected", "deferred"]

# --- Fixed values: properties expected of a solvent ---
EXPECTED_SOLVENT_PROPERTIES = ["ionic_conductivity", "ionization_energy", "electron_affinity"]

# --- Fixed values: curated property name | property type ---
CURATED_PROPERTY_MAP = """
ionization_energy|ionization_energy
electron_affinity|electron_affinity
homo_energy|homo_energy
lumo_energy|lumo_energy
oxidation_potential|oxidation_potential_li
reduction_potential|reduction_potential_li
dielectric_constant|dielectric_constant
thermal_stability|thermal_stability
lattice_energy|lattice_energy
oxidation_stability|oxidation_stability
"""

# --- Fixed values: computed-molecule property column | unit ---
GENOME_PROPERTIES = [
    ("ionization_energy", "eV"), ("electron_affinity", "eV"),
    ("oxidation_potential_li", "V"), ("reduction_potential_li", "V"),
    ("oxidation_potential_mg", "V"), ("reduction_potential_mg", "V"),
    ("oxidation_potential_h", "V"), ("reduction_potential_h", "V"),
]

# --- Fixed values: abbreviation | structure (atlas source) ---
ATLAS_STRUCTURES = r"""
LiPF6|[Li+].F[P-](F)(F)(F)(F)F
LiBF4|[Li+].F[B-](F)(F)F
LiFSI|[Li+].[N-](S(=O)(=O)F)S(=O)(=O)F
LiTDI|[Li+].C(#N)C1=C(N=C([N-]1)C(F)(F)F)C#N
LiPDI|C(#N)C1=C(N=C(N1)C(C(F)(F)F)(F)F)C#N
LiTFSI|[Li]N(S(=O)(=O)C(F)(F)F)S(=O)(=O)C(F)(F)F
LiClO4|[Li+].[O-]Cl(=O)(=O)=O
LiAsF6|[Li+].F[As-](F)(F)(F)(F)F
LiBOB|[Li+].O=C1O[B-]2(OC1=O)OC(=O)C(=O)O2
LiCF3SO3|[Li+].[O-]S(=O)(=O)C(F)(F)F
LiBPFPB|[Li+].FC(F)(F)C(O[B-]1(OC2(C(F)(F)F)C(F)(F)F)OC2(C(F)(F)F)C(F)(F)F)(C(O1)(C(F)(F)F)C(F)(F)F)C(F)(F)F
LiBMB|[Li+].O=C(CC(=O)O1)O[B-]1(OC(C1)=O)OC1=O
LiN(CF3SO2)2|[Li+].C(F)(F)(F)S(=O)(=O)[N-]S(=O)(=O)C(F)(F)F
EC|C1COC(=O)O1
PC|CC1COC(=O)O1
DMC|COC(=O)OC
EMC|CCOC(=O)OC
DEC|CCOC(=O)OCC
DME|COCCOC
DMSO|CS(=O)C
AN|CC#N
MOEMC|COCCOC(=O)OC
TFP|C(C(F)(F)F)OP(=O)(OCC(F)(F)F)OCC(F)(F)F
EA|CCOC(=O)C
MA|CC(=O)OC
FEC|C1C(OC(=O)O1)F
DOL|C1COCO1
2-MeTHF|CC1CCCO1
DMM|COCC(C)OC(C)COC
Freon 11|C(F)(Cl)(Cl)Cl
Methylene chloride|C(Cl)Cl
THF|C1CCOC1
Toluene|CC1=CC=CC=C1
Sulfolane|O=S1(=O)CCCC1
2-Glyme|COCCOCCOC
3-Glyme|COCCOCCOCCOC
4-Glyme|COCCOCCOCCOCCOC
3-Me-2-Oxazolidinone|CN1CCOC1=O
3-MeSulfolane|CC1CCS(=O)(=O)C1
Ethyldiglyme|CCOCCOCCO
DMF|CN(C)C=O
Ethylbenzene|CCC1=CC=CC=C1
Ethylmonoglyme|COCCO
Benzene|C1=CC=CC=C1
g-Butyrolactone|C1CC(=O)OC1
Cumene|CC(C)C1=CC=CC=C1
Propylsulfone|CCCS(=O)(=O)CCC
Pseudocumeme|CC1=CC(=C(C=C1)C)C
TEOS|CCO[Si](OCC)(OCC)OCC
m-Xylene|CC1=CC(=CC=C1)C
o-Xylene|CC1=CC=CC=C1C
"""

# --- Fixed values: solvent fraction columns of the atlas, in file order ---
ATLAS_SOLVENTS = [
    "EC", "PC", "DMC", "EMC", "DEC", "DME", "DMSO", "AN", "MOEMC", "TFP",
    "EA", "MA", "FEC", "DOL", "2-MeTHF", "DMM", "Freon 11", "Methylene chloride",
    "THF", "Toluene", "Sulfolane", "2-Glyme", "3-Glyme", "4-Glyme",
    "3-Me-2-Oxazolidinone", "3-MeSulfolane", "Ethyldiglyme", "DMF",
    "Ethylbenzene", "Ethylmonoglyme", "Benzene", "g-Butyrolactone",
    "Cumene", "Propylsulfone", "Pseudocumeme", "TEOS", "m-Xylene", "o-Xylene",
]

# --- Fixed values: abbreviation | full name ---
COMPOUND_NAMES = """
EC|Ethylene carbonate
PC|Propylene carbonate
DMC|Dimethyl carbonate
EMC|Ethyl methyl carbonate
DEC|Diethyl carbonate
DME|Dimethoxyethane
DMSO|Dimethyl sulfoxide
AN|Acetonitrile
FEC|Fluoroethylene carbonate
DOL|Dioxolane
THF|Tetrahydrofuran
DMF|Dimethylformamide
LiPF6|Lithium hexafluorophosphate
LiBF4|Lithium tetrafluoroborate
LiFSI|Lithium bis(fluorosulfonyl)imide
LiTFSI|Lithium bis(trifluoromethanesulfonyl)imide
LiClO4|Lithium perchlorate
LiBOB|Lithium bis(oxalato)borate
"""

# --- Fixed values: structure | readable name ---
STRUCTURE_NAMES = r"""
C1COC(=O)O1|Ethylene carbonate
O=C1OCCO1|Ethylene carbonate
CC1COC(=O)O1|Propylene carbonate
COC(=O)OC|Dimethyl carbonate
CCOC(=O)OC|Ethyl methyl carbonate
CCOC(=O)OCC|Diethyl carbonate
C1C(OC(=O)O1)F|Fluoroethylene carbonate
C=C1OC(=O)O1|Vinylene carbonate
COCCOC|1,2-Dimethoxyethane
COCCOCCOC|Diglyme
COCCOCCOCCOC|Triglyme
COCCOCCOCCOCCOC|Tetraglyme
CS(=O)C|Dimethyl sulfoxide
CC#N|Acetonitrile
C1CCOC1|Tetrahydrofuran
C1COCO1|1,3-Dioxolane
O=S1(=O)CCCC1|Sulfolane
CN(C)C=O|Dimethylformamide
C1CC(=O)OC1|gamma-Butyrolactone
[Li+].F[P-](F)(F)(F)(F)F|LiPF6
[Li+].F[B-](F)(F)F|LiBF4
[Li+].C(F)(F)(F)S(=O)(=O)[N-]S(=O)(=O)C(F)(F)F|LiTFSI
[Li]N(S(=O)(=O)C(F)(F)F)S(=O)(=O)C(F)(F)F|LiTFSI
[Li+].[N-](S(=O)(=O)F)S(=O)(=O)F|LiFSI
[Li+].[O-]Cl(=O)(=O)=O|LiClO4
[Li+].[O-][Cl+3]([O-])([O-])[O-]|LiClO4
[Li+].O=C1O[B-]2(OC1=O)OC(=O)C(=O)O2|LiBOB
[Li+].[O-]S(=O)(=O)C(F)(F)F|LiOTf
F[As-](F)(F)(F)(F)F.[Li+]|LiAsF6
[Na+].F[P-](F)(F)(F)(F)F|NaPF6
[Na+].C(F)(F)(F)S(=O)(=O)[N-]S(=O)(=O)C(F)(F)F|NaTFSI
[Na+].[N-](S(=O)(=O)F)S(=O)(=O)F|NaFSI
[Na+].[O-]Cl(=O)(=O)=O|NaClO4
"""

# --- Fixed values: normalised material name | structure (empty = known, no structure) ---
KNOWN_MATERIALS = r"""
lipf6|[Li+].F[P-](F)(F)(F)(F)F
lithium hexafluorophosphate|[Li+].F[P-](F)(F)(F)(F)F
libf4|[Li+].F[B-](F)(F)F
lithium tetrafluoroborate|[Li+].F[B-](F)(F)F
litfsi|[Li+].C(F)(F)(F)S(=O)(=O)[N-]S(=O)(=O)C(F)(F)F
lithium bis(trifluoromethanesulfonyl)imide|[Li+].C(F)(F)(F)S(=O)(=O)[N-]S(=O)(=O)C(F)(F)F
lifsi|[Li+].[N-](S(=O)(=O)F)S(=O)(=O)F
lithium bis(fluorosulfonyl)imide|[Li+].[N-](S(=O)(=O)F)S(=O)(=O)F
liclo4|[Li+].[O-]Cl(=O)(=O)=O
lithium perchlorate|[Li+].[O-]Cl(=O)(=O)=O
libob|[Li+].O=C1O[B-]2(OC1=O)OC(=O)C(=O)O2
lithium bis(oxalato)borate|[Li+].O=C1O[B-]2(OC1=O)OC(=O)C(=O)O2
licf3so3|[Li+].[O-]S(=O)(=O)C(F)(F)F
lithium triflate|[Li+].[O-]S(=O)(=O)C(F)(F)F
lithium trifluoromethanesulfonate|[Li+].[O-]S(=O)(=O)C(F)(F)F
liasf6|[Li+].F[As-](F)(F)(F)(F)F
lithium hexafluoroarsenate|[Li+].F[As-](F)(F)(F)(F)F
napf6|[Na+].F[P-](F)(F)(F)(F)F
sodium hexafluorophosphate|[Na+].F[P-](F)(F)(F)(F)F
natfsi|[Na+].C(F)(F)(F)S(=O)(=O)[N-]S(=O)(=O)C(F)(F)F
sodium bis(trifluoromethanesulfonyl)imide|[Na+].C(F)(F)(F)S(=O)(=O)[N-]S(=O)(=O)C(F)(F)F
nafsi|[Na+].[N-](S(=O)(=O)F)S(=O)(=O)F
naclo4|[Na+].[O-]Cl(=O)(=O)=O
sodium perchlorate|[Na+].[O-]Cl(=O)(=O)=O
ec|C1COC(=O)O1
ethylene carbonate|C1COC(=O)O1
pc|CC1COC(=O)O1
propylene carbonate|CC1COC(=O)O1
dmc|COC(=O)OC
dimethyl carbonate|COC(=O)OC
emc|CCOC(=O)OC
ethyl methyl carbonate|CCOC(=O)OC
dec|CCOC(=O)OCC
diethyl carbonate|CCOC(=O)OCC
fec|C1C(OC(=O)O1)F
fluoroethylene carbonate|C1C(OC(=O)O1)F
vc|C=C1OC(=O)O1
vinylene carbonate|C=C1OC(=O)O1
dme|COCCOC
dimethoxyethane|COCCOC
1,2-dimethoxyethane|COCCOC
diglyme|COCCOCCOC
triglyme|COCCOCCOCCOC
tetraglyme|COCCOCCOCCOCCOC
tetraethylene glycol dimethyl ether|COCCOCCOCCOCCOC
dmso|CS(=O)C
dimethyl sulfoxide|CS(=O)C
acetonitrile|CC#N
thf|C1CCOC1
tetrahydrofuran|C1CCOC1
dol|C1COCO1
1,3-dioxolane|C1COCO1
sulfolane|O=S1(=O)CCCC1
dmf|CN(C)C=O
dimethylformamide|CN(C)C=O
gbl|C1CC(=O)OC1
gamma-butyrolactone|C1CC(=O)OC1
g-butyrolactone|C1CC(=O)OC1
li10gep2s12|
lgps|
li7la3zr2o12|
llzo|
li3ps4|
na3ps4|
li6ps5cl|
nasicon|
lipon|
"""

# --- Fixed values: abbreviation | name | structure | CAS | registry id | weight | role ---
COMPOSITION_MOLECULES = r"""
EC|Ethylene carbonate|O=C1OCCO1|96-49-1|7303|88.06|solvent
PC|Propylene carbonate|CC1COC(=O)O1|108-32-7|7924|102.09|solvent
EMC|Ethyl methyl carbonate|CCOC(=O)OC|623-53-0|522046|104.11|solvent
DMC|Dimethyl carbonate|COC(=O)OC|616-38-6|12021|90.08|solvent
LiPF6|Lithium hexafluorophosphate|[Li+].F[P-](F)(F)(F)(F)F|21324-40-3|23688284|151.91|salt
"""

# --- Fixed values: keyword lists of the text classifiers ---
ELECTROLYTE_KEYWORDS = [
    "electrolyte", "salt", "carbonate", "glyme", "tfsi", "fsi",
    "pf6", "bf4", "clo4", "triflate", "perchlorate", "sulfone",
    "sulfolane", "acetonitrile", "dme", "thf", "dioxolane",
    "polymer electrolyte", "gel electrolyte", "solid electrolyte",
    "ionic liquid", "lgps", "llzo", "nasicon", "argyrodite",
    "li3ps4", "na3ps4", "li6ps5", "li7la3zr2o12", "li10gep2s12",
]
ELECTRODE_KEYWORDS = [
    "cathode", "anode", "licoo2", "limno2", "linio2", "lfp",
    "lifepo4", "graphite", "silicon", "carbon nanotube", "cnt",
    "mno2", "v2o5", "tio2", "nmc", "nca", "lmo", "electrode",
]
SALT_NAME_PARTS = ["li", "na", "salt", "pf6", "bf4", "tfsi", "fsi", "clo4", "triflate"]
SALT_INDICATORS = [
    "lithium", "sodium", "lipf6", "libf4", "litfsi", "lifsi",
    "napf6", "nabf4", "natfsi", "nafsi", "liclo4", "naclo4",
]
SOLVENT_INDICATORS = [
    "carbonate", "ether", "sulfoxide", "sulfone", "acetonitrile",
    "tetrahydrofuran", "dioxolane", "glyme", "lactone", "furan",
]
COMPOSITION_CATIONS = ["Li", "Na"]
COMPOSITION_ANIONS = ["P", "F", "S", "B", "Cl", "N"]

# --- Fixed values: category | where | substring, tested top to bottom; last resort "Other" ---
SOURCE_CATEGORIES = [
    ("ML Predictions (Electrolytomics)", "method", "ml_prediction"),
    ("Electrolytomics (Experimental)", "doi", "10.1021/acs.chemmater.4c03196"),
    ("ChemDataExtractor", "doi", "10.1038/s41597-020-00602-2"),
    ("ChemDataExtractor", "method_lower", "chemdataextractor"),
    ("CALiSol-23", "doi", "10.1038/s41597-024-03575-8"),
    ("Materials Project", "method", "materials_project"),
    ("Materials Project", "method_lower", "electrolyte_genome"),
    ("Curated Properties", "method_lower", "curated"),
    ("LIBE (Interphase)", "method_lower", "libe"),
    ("HI Münster", "method_lower", "conductivity_dataset"),
    ("HI Münster", "method_lower", "hi_munster"),
]

# --- Fixed values: predicate | inference method ---
RELATION_BASIS = """
sameAs|SMILES String Matching
hasMeasurement|Direct Dataset Import
decomposesTo|Literature Knowledge
coOccursWith|Association Rule Mining
increases|Correlation Analysis
decreases|Correlation Analysis
hasSolvent|Direct Dataset Import
hasSalt|Direct Dataset Import
"""

# --- Fixed values: source type | name | DOI of each ingested dataset ---
DATASETS = """
composition|dataset|HI Münster Conductivity Dataset|10.1038/s41597-023-01936-3
atlas|dataset|CALiSol-23|10.1038/s41597-024-03575-8
experimental|dataset|Electrolytomics|10.1021/acs.chemmater.4c03196
literature|dataset|ChemDataExtractor-Battery-v2|10.6084/m9.figshare.18154715
genome|dataset|Materials Project Electrolyte Genome|10.1016/j.commatsci.2015.02.050
predictions|ml_predictions|Electrolytomics ML Predictions|10.1021/acs.chemmater.4c03196
species|dataset|LIBE|10.1038/s41597-021-00986-9
curated|curation|Curated Electrochemical Properties|
"""


def rows(text: str) -> list[tuple]:
    """Parse a pipe-separated table above; empty cells become null."""
    return [tuple(c or None for c in line.split("|")) for line in text.strip().splitlines()]


def dimension(spark: SparkSession, text: str, columns: list[str]) -> DataFrame:
    """A lookup table as a (fixed-size) DataFrame of strings."""
    return spark.createDataFrame(rows(text), ", ".join(f"`{c}` string" for c in columns))
