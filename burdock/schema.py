"""Vocabulary and record types of the proteome tables."""

from __future__ import annotations

# Biological alphabets, scales and labels.
RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
#: Degenerate residue groups, numbered 0 to 5.
GROUPS = ("G", "KPR", "ILV", "FWY", "ACHM", "DENQST")
#: Hydropathy (Kyte and Doolittle 1982).
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}
CHARGE = {"K": 1.0, "R": 1.0, "H": 0.1, "D": -1.0, "E": -1.0}
AROMATIC, ALPHA, BETA = "FWY", "ALEMQKRH", "VIYFWTC"
#: Standard genetic code, codons in TCAG order.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
MITOCHONDRIAL = ("chrM", "M", "MT")
CONSENSUS_ORDER = ("Amyloid", "Partial", "Discordant", "Non-Amyloid")
CLASS_ORDER = ("Amyloidogenic", "Intermediate", "Non-Amyloidogenic")
POSITIVE, NEGATIVE = "AMYLOID", "Non-Amyloid"
#: Cut points (low, high) of the probability classes of the six-mer and of the ensemble predictor.
SIXMER_CUTS, ENSEMBLE_CUTS = (0.1206, 0.8802), (0.6947, 0.8898)
STRINGENT_CUTS = (0.2, 0.9)
COMPOSITION_GROUPS = {"aliphatic": "GAVLMI", "aromatic": "FYW", "positive": "KRH", "negative": "DE", "uncharged": "STCPNQ"}
#: Dimer-triad groups of the conjoint triad.
TRIAD_GROUPS = ("AGV", "ILFP", "YMTS", "HNQW", "RK", "DE", "C")
#: Three classes of a property for composition, transition and distribution.
CTD = {
    "hydrophobicity_PRAM900101": ("RKEDQN", "GASTPHY", "CLVIMFW"),
    "hydrophobicity_ARGP820101": ("QSTNGDE", "RAHCKMV", "LYPFIW"),
    "hydrophobicity_ZIMJ680101": ("QNGSWTDERA", "HMCKV", "LPFYI"),
    "hydrophobicity_PONP930101": ("KPDESNQT", "GRHA", "YMFWLCVI"),
    "hydrophobicity_CASG920101": ("KDEQPSRNTG", "AHYMLV", "FIWC"),
    "hydrophobicity_ENGD860101": ("RDKENQHYP", "SGTAW", "CVLIMF"),
    "hydrophobicity_FASG890101": ("KERSQD", "NTPG", "AYHWVMFLIC"),
    "normwaalsvolume": ("GASTPDC", "NVEQIL", "MHKFRYW"),
    "polarity": ("LIFWCMVY", "PATGS", "HQRKNED"),
    "polarizability": ("GASDT", "CPNVEQIL", "KMHFRYW"),
    "charge": ("KR", "ANCQGHILMFPSTWYV", "DE"),
    "secondarystruct": ("EALMQKRH", "VIYCWFT", "GNPSD"),
    "solventaccess": ("ALFCGIVW", "RKQEND", "MSPTHY"),
}
#: Letter order and scales of the pseudo-composition descriptors.
PSEUDO_ORDER = "ARNDCQEGHILKMFPSTWYV"
PSEUDO = {
    "Hydrophobicity": (0.62, -2.53, -0.78, -0.9, 0.29, -0.85, -0.74, 0.48, -0.4, 1.38, 1.06, -1.5, 0.64, 1.19, 0.12, -0.18, -0.05, 0.81, 0.26, 1.08),
    "Hydrophilicity": (-0.5, 3, 0.2, 3, -1, 0.2, 3, 0, -0.5, -1.8, -1.8, 3, -1.3, -2.5, 0, 0.3, -0.4, -3.4, -2.3, -1.5),
    "SideChainMass": (15, 101, 58, 59, 47, 72, 73, 1, 82, 57, 57, 73, 75, 91, 42, 31, 45, 130, 107, 43),
}
#: Helix and sheet propensities (Chou and Fasman 1978), AAindex CHOP780201 and CHOP780202.
HELIX = {"A": 1.42, "R": 0.98, "N": 0.67, "D": 1.01, "C": 0.70, "Q": 1.11, "E": 1.51, "G": 0.57, "H": 1.00, "I": 1.08, "L": 1.21, "K": 1.16, "M": 1.45, "F": 1.13, "P": 0.57, "S": 0.77, "T": 0.83, "W": 1.08, "Y": 0.69, "V": 1.06}
SHEET = {"A": 0.83, "R": 0.93, "N": 0.89, "D": 0.54, "C": 1.19, "Q": 1.10, "E": 0.37, "G": 0.75, "H": 0.87, "I": 1.60, "L": 1.30, "K": 0.74, "M": 1.05, "F": 1.38, "P": 0.55, "S": 0.75, "T": 1.19, "W": 1.37, "Y": 1.47, "V": 1.70}
#: Acid constants; n and c are the two ends of the chain.
PK_LEHNINGER = {"C": 8.18, "D": 3.65, "E": 4.25, "H": 6.00, "K": 10.53, "R": 12.48, "Y": 10.07, "c": 2.34, "n": 9.69}
PK_EMBOSS = {"C": 8.5, "D": 3.9, "E": 4.1, "H": 6.5, "K": 10.8, "R": 12.5, "Y": 10.1, "c": 3.6, "n": 8.6}

CODONS = {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
SIXMERS = 6**6

GTF = "seqname string, source string, feature string, start int, end int, score string, strand string, frame string, attribute string"
VCF = "CHROM string, POS int, ID string, REF string, ALT string, QUAL string, FILTER string, INFO string, FORMAT string, sample string"
ABUNDANCE = "target_id string, length double, eff_length double, est_counts double, tpm string"
HLA = "sample string, caller string, locus string, allele string, rank int, source_file string"
