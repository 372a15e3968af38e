"""Parameter values used by the registered queries and their SQL."""

DRUG_LIST = "00000005"
COUNTY = "29003"
STATE = "AS"
STATE_NAME = "ASIA"
CONTRACT = "H0005"
ORGANIZATION = "Humana Inc."
ORG_NAME = "NATION_3"
ORG_PART = "NATION_1"
COMPANY_NAMES = ("Nation_1", "Aetna")
SEARCH = "health"
TIER = 5
NDC = "00000000028"
MEMBER_NDCS = ("00000000580", "00000000626", "00000000667")
DRUG_GROUPS = {
    "Drug A": (1, 2, 3),
    "Drug B": (4, 5, 6, 7, 8),
    "Drug C": (9, 10, 11),
    "Drug D": (12, 13, 14, 15, 16, 17),
    "Drug E": (18, 19, 20, 21),
    "Drug F": (22,),
}
PRIORITY = (12, 100, 500)
