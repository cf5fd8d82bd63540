"""Word lists and patterns of the extraction rules.

Fixed values: results depend on each of them, so they are stated plainly and in the order in which they are tried.
"""

UNITS = {"crore": 1e7, "crores": 1e7, "cr": 1e7, "crs": 1e7, "lakh": 1e5, "lakhs": 1e5, "lac": 1e5, "lacs": 1e5, "million": 1e6, "millions": 1e6, "mn": 1e6, "mio": 1e6, "billion": 1e9, "billions": 1e9, "bn": 1e9, "thousand": 1e3, "arab": 1e9}
CURRENCIES = {"₹": "INR", "rs": "INR", "rs.": "INR", "inr": "INR", "rupees": "INR", "rupee": "INR", "$": "USD", "us$": "USD", "usd": "USD", "€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR", "£": "GBP", "gbp": "GBP"}
NUMBER = r"\d{1,3}(?:,\d{2,3})+(?:\.\d+)?|\d+(?:\.\d+)?"
CURRENCY = r"₹|Rs\.?|INR|US\s?\$|USD|\$|EUR|€|GBP|£"
UNIT = r"crores?|crs?\.?|lakhs?|lacs?|millions?|mn\.?|mio|billions?|bn\.?|thousand|arab"
VALUE_CUES = ["order value", "contract value", "value of the order", "value of the contract", "total value", "aggregate value", "aggregating to", "amounting to", "worth", "valued at", "for a value of", "order worth", "contract worth", "order of", "consideration of", "project cost", "total order value", "estimated value", "approximate value", "order size", "tender value", "deal value", "contract price", "value (excluding", "value (including", "order aggregating", "of the order is", "order amount", "size of the order", "size of the contract", "value of the work order", "total consideration", "order value (in", "value (in rs", "monetary value", "approximate monetary value"]
VALUE_ANTI_CUES = ["paid-up", "paid up capital", "face value", "share capital", "authorised capital", "authorized capital", "net worth", "turnover", "gst", "goods and services tax", "emd", "earnest money", "security deposit", "bank guarantee", "performance guarantee", "retention money", "penalty", "liquidated damages", "per share", "per equity share", "dividend", "fine of", "fees of", "stamp duty", "market capitalisation", "market capitalization", "revenue for the", "profit", "borrowing", "loan of", "credit facility", "equity shares of", "nominal value", "premium of", "warrant", "isin", "cin", "registered office", "pin", "phone", "telephone", "tel:", "capital expenditure", "capex", "funded through", "funded by", "internal accruals", "internal resources", "project entails", "estimated cost", "investment of", "outlay", "expected to generate", "expected to clock", "at peak", "peak operations", "full utilisation", "full utilization", "revenue potential", "estimated revenue", "annual revenue", "revenue of approximately", "once operational", "on full ramp", "at maturity", "total income of", "expecting total income", "expected total income", "expecting turnover", "expected turnover", "additional turnover", "expecting revenue", "expected revenue", "revenue guidance", "pat of", "profit after tax of", "net profit of", "we are expecting", "targeting"]
TAX_TAILS = ["excluding gst", "including gst", "plus gst", "exclusive of tax", "inclusive of tax", "excluding taxes", "plus taxes", "excl. gst"]

NUMBER_WORDS = {"half": 0.5, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "twenty-four": 24, "twentyfour": 24, "thirty": 30, "thirty-six": 36, "thirtysix": 36, "forty": 40, "forty-five": 45, "fortyfive": 45, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100}
DURATION_LEADS = r"with(?:in)?|over|period of|completion (?:period|time|timeline) of|execution period of|executed? (?:with)?in|spread over|duration of|tenure of|complete[d]? (?:with)?in|to be (?:completed|executed) (?:with)?in|stipulated (?:completion )?(?:timeline|period|time) of|delivery schedule is for|operational within|initially|valid for|term of|for a period of|(?:purchase )?(?:orders?|contracts?) is for"
DURATION_TAILS = r"from the date of|from date of|execution period|completion period|order period|contract period"
DURATION_LABEL = r"time\s*period[^.\n]{0,80}?(?:by\s+which|associated\s+with|for\s+(?:the\s+)?(?:execution|completion)|of\s+(?:the\s+)?(?:order|contract))"

ORDER_TRIGGERS = ["letter of award", "letter of intent", "loa", "lol", "work order", "purchase order", "supply order", "order received", "receipt of order", "award of order", "secured an order", "secured order", "wins order", "won order", "awarded", "award of contract", "contract won", "new order", "order book", "order intake", "emerged as l1", "lowest bidder", "l-1 bidder", "declared l1", "notice to proceed", "contract agreement", "framework agreement", "rate contract", "order win", "receipt of work order", "bags order", "bags contract", "development agreement", "epc contract", "o&m contract", "export order", "domestic order", "order worth", "order valued", "received an order", "receipt of an order", "supply contract", "memorandum of understanding", "mou", "notification of award", "confirmed order", "order confirmation", "repeat order"]
ORDER_PATTERNS = [
    r"\b(?:receiv|secur|bagg?|won|win[s]?|award|obtain|procur|land)\w*\b[^.\n]{0,60}?\b(?:orders?|contracts?|loa|tenders?|projects?)\b",
    r"\b(?:orders?|contracts?)\b[^.\n]{0,40}?\b(?:worth|valued at|value of|aggregating|amounting)\b",
    r"\borders?\s+(?:book|intake|inflow)\b",
]
FIRMNESS = {
    1.00: ["letter of award", "loa", "work order", "purchase order", "supply order", "contract agreement", "notice to proceed", "definitive agreement", "signed contract", "executed contract", "notification of award", "letter of commencement", "award of contract", "works contract", "supply contract", "service contract", "commercial order", "service order"],
    0.60: ["letter of intent", "loi", "lol", "in-principle", "in principle"],
    0.40: ["emerged as l1", "lowest bidder", "l-1 bidder", "declared l1", "preferred bidder", "selected as"],
    0.30: ["memorandum of understanding", "mou", "framework agreement", "rate contract", "empanel", "strategic partnership"],
}
QUALITY_BUMPS = {"export": 0.15, "overseas": 0.12, "international": 0.10, "defence": 0.20, "defense": 0.20, "aerospace": 0.15, "repeat order": 0.10, "operation and maintenance": 0.12, "o&m": 0.12, "annuity": 0.15, "ham": 0.10, "semiconductor": 0.15, "data centre": 0.12, "data center": 0.12, "railway": 0.05, "metro": 0.05, "transmission": 0.08}
QUALITY_DINGS = {"lowest bidder": -0.10, "l1": -0.05, "road": -0.05, "civil work": -0.08, "building construction": -0.08, "subject to": -0.05, "tentative": -0.10, "estimated": -0.05}
AMENDMENTS = ["cancellation", "cancelled", "termination", "terminated", "foreclosure", "withdrawal of order", "revision in order", "revised order value", "amendment to", "amended order", "short closure", "short-closure", "deferment", "put on hold", "rescinded", "clarification on", "corrigendum", "reduction in order"]
NOT_ORDER_TOPICS = ["financial result", "results for the quarter", "limited review", "review report", "discrepanc", "annual report", "investor presentation", "analyst", "institutional investor", "con. call", "conference call", "earnings call", "credit rating", "raising of funds", "rights issue", "preferential issue", "trading window", "postal ballot", "registered office", "working capital", "loan agreement", "newspaper publication", "shareholding pattern"]
RELATED_PARTY = ["wholly owned subsidiary", "holding company", "group company", "associate company", "related party", "promoter group"]
NON_ORDER = ["order from bse", "order from nse", "order from sebi", "order from the exchange", "order from the stock exchange", "adjudication", "adjudicating officer", "sebi order", "show cause", "penalty order", "penalty notice", "nclt", "nclat", "sat order", "insolvency", "liquidation", "moratorium", "resolution professional", "high court", "supreme court", "tribunal", "court order", "arbitration award", "arbitral award", "recovery order", "attachment order", "garnishee", "debarment", "freezing order", "assessment order", "reassessment", "income tax", "tax demand", "demand order", "demand notice", "refund order", "credit rating", "rating action", "rating assigned", "rating revision", "revision in rating", "reaffirm", "icra", "crisil", "care ratings", "india ratings", "brickwork", "acuite", "infomerics", "rumour verification", "rumor verification", "regulation 30(11)", "clarification sought", "price movement", "newspaper publication"]
NON_ORDER_PATTERNS = [
    r"\borders?\s+(?:passed|issued|received|served)\s+(?:by|from)\s+(?:the\s+)?(?:hon|sebi|bse|nse|nclt|nclat|cci|rbi|dgft|commissioner|assessing|adjudicat|income[-\s]?tax|gst|customs|excise|tribunal|court)",
    r"\b(?:icra|crisil|care|india|acuite|infomerics)\s+ratings?\b",
]
GENERIC_HEADLINES = ["general update", "updates", "press release", "announcement", "disclosure", "intimation", "corporate announcement", "other", "submission", "regulation 30", "reg. 30", "reg 30"]
NEVER_ORDER = ["analyst", "institutional investor", "shareholders meeting", "newspaper", "board meeting", "credit rating", "esop", "esos", "esps", "price movement", "spurt in volume", "resignation", "appointment", "trading window", "annual report", "agm", "egm", "postal ballot", "dividend", "buyback", "share transfer", "compliance certificate", "shareholding pattern", "financial result", "investor presentation", "earnings call", "conference call", "duplicate share", "loss of share", "sub-division", "record date", "book closure", "allotment", "warrant", "pledge", "encumbrance", "related party transaction", "secretarial", "auditor", "cessation", "regulation 74", "reg. 74", "certificate under", "monitoring agency", "utilisation of funds", "rumour", "rumor", "clarification", "change in management", "change in director", "insolvency resolution", "amalgamation", "merger", "corrigendum"]
OWN_PROJECT = [
    r"\b(?:letter of intent|loi|lol|in-principle approval|approval|licen[cs]e|permission|allotment|concession|clearance)\b[^.\n]{0,90}?\bfor\b[^.\n]{0,40}?\b(?:setting up|set up|establishment|establishing|development|construction|installation|commissioning)\b",
    r"\bestimated capital expenditure\b", r"\bcapital expenditure of\b", r"\bcapex of\b",
    r"\bfunded (?:through|by)\b[^.\n]{0,70}?\b(?:debt|internal accruals|internal resources|equity|ipo proceeds)\b",
    r"\b(?:capacity|strategic|brownfield|greenfield)\s+expansion\b", r"\bexpansion of (?:its|our|the compan(?:y|y's))\b",
    r"\bexpected to generate revenue\b", r"\bat peak (?:operations|utilisation|utilization|capacity)\b", r"\bfull (?:utilisation|utilization)\b",
    r"\bcommencement of commercial (?:production|operations)\b", r"\bown (?:plant|facility|unit|manufacturing|premises)\b", r"\bproposed (?:plant|facility|unit|project)\b",
]
OWN_PROJECT_LEAST = 2
JUNK_CUSTOMERS = ["the compan", "compan", "a compan", "one of", "its ", "our ", "the said", "the customer", "the client", "the above", "the same", "an entity", "a customer", "a client", "a party", "the party", "us ", "we ", "time to", "such ", "this ", "that ", "which ", "whom ", "them ", "various ", "certain ", "other ", "multiple ", "domestic ", "overseas custom"]
GOVERNMENT = ["ministry", "government", "govt", "department of", "municipal", "corporation of", "authority", "nigam", "board", "council", "commission", "railways", "indian railways", "nhai", "pwd", "cpwd", "mes", "smart city", "jal nigam", "vidyut", "discom", "state of"]
PUBLIC_SECTOR = ["ntpc", "ongc", "bhel", "sail", "gail", "iocl", "indian oil", "bpcl", "hpcl", "powergrid", "power grid", "coal india", "nmdc", "hal", "bel ", "bharat electronics", "drdo", "isro", "nalco", "rites", "ircon", "rvnl", "irctc", "cochin shipyard", "mazagon", "garden reach", "oil india", "nhpc", "sjvn", "thdc", "neepco", "bsnl", "mtnl", "concor"]
EXPORT = ["export", "overseas", "international", "usa", "u.s.a", "united states", "europe", "middle east", "africa", "uae", "saudi", "qatar", "oman", "kuwait", "bahrain", "singapore", "malaysia", "vietnam", "bangladesh", "nepal", "sri lanka", "australia", "canada", "germany", "france", "uk ", "united kingdom", "japan", "korea", "brazil", "mexico"]
LEGAL_SUFFIX = r"\b(?:limited|ltd|private|pvt|public|plc|incorporated|inc|corporation|corpn|company|co)\b\.?"
CUSTOMER_PATTERNS = [
    r"(?:order|contract|loa|letter of award|letter of intent|work order|purchase order)s?\s+(?:has been\s+)?(?:received\s+)?(?:from|awarded by|by|placed by)\s+(?:M/s\.?\s*)?([A-Z][A-Za-z0-9&.,'\-\(\) ]{3,80}?)(?=\s*(?:,|\.|\sfor\s|\sto\s|\sworth|\svalued|\samounting|\sunder|\sas |$))",
    r"(?:from|by)\s+(?:M/s\.?\s*)?([A-Z][A-Za-z0-9&.,'\-\(\) ]{5,80}?(?:Limited|Ltd\.?|Corporation|Corpn\.?|Board|Authority|Nigam|Council|Commission|Department|Railways?|Ministry|Municipal|Institute|University|Inc\.?|LLC|GmbH|PLC|Pvt\.?\s*Ltd\.?))",
]

BOOK_CANDIDATE = r"investor\s+presentation|earnings\s+call\s+transcript|transcript|press\s+release|media\s+release|order\s*book|order\s+position|unexecuted|financial\s+results?\s+(?:press|release|update)|earnings\s+(?:update|release)|results?\s+press"
BOOK_NOT_CANDIDATE = r"newspaper|intimation\s+of\s+(?:analyst|investor)\s+meet|schedule\s+of"
BOOK_PRIORITY = {"presentation": 0, "results": 1, "update": 2, "transcript": 3, "press_release": 4, "order_win": 5, "annual": 6, "other": 7}
BOOK_MENTIONS = ["order book", "orderbook", "order-book", "order backlog", "unexecuted order", "orders in hand", "outstanding orders", "pending orders"]
SOURCE_RANK = {"update": 0, "results": 0, "presentation": 1, "order_win": 1, "press_release": 2, "annual": 2, "other": 3, "transcript": 3}
PERIOD_DAYS = {"3m": 92, "6m": 183, "1y": 366, "all": 100000}
LEAST_GROWTH_DAYS, SUSPECT_STEP = 60, 4.0

FORWARD = r"\b(?:expect\w*|target\w*|guidance|guided|aim(?:s|ing)?\s+to|projected|projects|outlook|anticipat\w*|envisag\w*|on\s+track\s+to|estimate[sd]?|plan(?:s|ning)?\s+to\s+(?:achieve|reach|clock|touch))\b"
NOT_COMPANY_WIDE = r"\badditional\s+(?:turnover|revenue|income|sales|business)\b|\bfrom\s+(?:the\s+)?(?:above|this|said|such|that)\s+(?:client|customer|order)\b|\bat\s+peak\b|\bfull\s+(?:capacity|utili[sz]ation)\b|\bplant\b|\bcapex\b|\border\s*(?:book|inflow|pipeline)\b"
FISCAL_YEAR = r"\bFY\s?'?(\d{4}|\d{2})(?:\s*[-–/]\s*'?(\d{4}|\d{2}))?\b"
GUIDED = {"pat": r"\b(?:pat|profit\s+after\s+tax|net\s+profit|bottom[\s-]?line)\b", "revenue": r"\b(?:total\s+income|revenues?(?:\s+from\s+operations)?|turnover|top[\s-]?line|net\s+sales|sales|income)\b"}
GROWTH = r"(?:grow\w*|growth|increase\w*|rise|jump)\s+(?:of\s+|by\s+)?(?:around\s+|about\s+|approximately\s+|over\s+)?(\d{1,3}(?:\.\d+)?)\s*%|(\d{1,3}(?:\.\d+)?)\s*%\s*(?:(?:[-–]|to)\s*\d{1,3}(?:\.\d+)?\s*%\s*)?(?:y-?o-?y\s+)?(?:growth|increase|rise|jump)"

# Order-book statements.
BOOK_ANCHOR = r"\border[\s-]?books?\b(?!\s*(?:ing|ed)\b)|\border\s+backlog\b|\bunexecuted\s+(?:orders?|order\s+value|projects?\s+value)\b(?!\s*(?:book|backlog))|\borders?\s+(?:in|on)\s+hand\b|\boutstanding\s+orders\b|\bpending\s+orders\b"
BOOK_OTHER_SENSE = r"international order book\s*\(iob\)|london stock exchange|book[\s-]?building|book running|oversubscri|bids? received|order[\s-]?book\s*(?:to|/)\s*(?:bill|revenue|sales)"
BOOK_FORWARD = r"\b(?:expect\w*|target\w*|aim(?:s|ing)?|plan(?:s|ning)?|aspir\w*|anticipat\w*|envisag\w*|projected|guid\w+|outlook|will\s+(?:build|reach|touch|cross)|would|potential|by\s+(?:the\s+)?(?:close|end)\s+of|by\s+fy)\b"
BOOK_REDUCTION = r"\b(?:reduction|reduced|decrease\w*|cancell?\w*|short[\s-]?clos\w*|impact)\b"
BOOK_CURRENCY = r"₹|Rs\.?|INR|US\s?\$|USD|\$|EUR|€|`"
BOOK_UNIT = r"lakh\s+crores?|crores?|crs?\b\.?|lakhs?|lacs?|millions?|mn\b|m\b|billions?|bn\b|b\b|k\b"
BOOK_UNITS = {"crore": 1e7, "cr": 1e7, "lakh": 1e5, "lac": 1e5, "lakh crore": 1e12, "million": 1e6, "mn": 1e6, "m": 1e6, "billion": 1e9, "bn": 1e9, "b": 1e9, "k": 1e3}
BOOK_INDIAN = ["crore", "cr", "lakh", "lac", "lakh crore"]
BOOK_APPROX = r"approximately|approx\.?|about|around|nearly|over|above|beyond|more than|close to|exceeds?|crosse?s|~"
BOOK_OTHER_QUANTITY = r"\b(?:inflows?|intake|new\s+orders?|wins?|won|addition|added|adds|orders?\s+(?:received|secured|negotiated)|negotiated|excluding\s+orders|revenues?|turnover|ebitda|pat|profits?|margins?|income|debt|cash|capex|guidance|pipeline|bids?|bidding|enquir\w*|tenders?|l-?1|market\s+cap\w*|valuation|share\s+capital|net\s+worth|reduction|while|whereas|of\s+which|out\s+of\s+which|comprising|representing|accounting|secured|received)\b"
BOOK_INFLOW_AFTER = r"\s*(?:\(?[^)]{0,30}\)\s*)?(?:of|in|worth\s+of)?\s*(?:new|fresh|additional)?\s*(?:orders?\b(?!\s*book)|order\s+(?:inflow|intake|wins?))"
BOOK_ORDER_BEFORE = r"\b(?:worth|valued|value\s+of|orders?\s+of|secur\w*|bag\w*|wins?|won|adds?|added|received|targeting|target\s+of(?:\s+a)?|reiterat\w*)\b[^.]{0,22}$"
BOOK_BINDING = r"\b(?:stands?|stood|is|was|of|at|reached|reaches|crossed|crosses|increased|grew|rose|touched|totals?|totalled|amounts?|aggregat\w*|valued|worth|to|now|currently|approximately|record|robust|healthy|strong|position|remains?|swells?|exceeds?|beyond)\b|[:–\-]"
BOOK_CHANGE = r"\b(?:from|increas\w*|grew|grow\w*|rose|rising|surg\w*|taking|takes|took|went\s+up|moved\s+up|strengthened|swell\w*|expand\w*|jump\w*)\b"
BOOK_SEGMENT_NEXT = r"\b(?:division|segment|vertical|(?<!key\s)(?<!our\s)business|export|domestic|overseas|international|transmission|smart\s+meter\w*|o&m|railway|nuclear|defen[cs]e|toll|bess|cng|omc|epc|manufacturing|telecom|ict|energy|data\s+cent(?:er|re)|dg\s+sets?|aftermarket|digital|advisory|ads)\b(?:\s+business)?(?:\s*\([^)]{0,12}\))?[^\w]{0,3}(?:&\s*\w+\s*)?$"
BOOK_SEGMENT = r"\b(?:division|segment|vertical|export|domestic|overseas|transmission|smart\s+meter\w*|o&m)\b"
BOOK_TOTAL = r"\b(?:total|overall|consolidated|group(?:'s|’s)?|company(?:'s|’s)|aggregate|entire)\b"
BOOK_FIGURE_NOT_BOOK = r"^\W{0,3}(?:crores?|cr\.?)?\s*(?:\(?\s*)?(?:(?:is|was|has\s+been|have\s+been)\s+)?(?:billed|executed|completed|recognised|recognized|invoiced|delivered)\b|^[^.;]{0,25}\bincluding\s+(?:the\s+)?(?:\w+\s+){0,3}(?:negotiat\w*|l-?1|pending\s+receipt)"
BOOK_REGION = r"^\s+(?:in|for)\s+(?!(?i:(?:the\s+)?(?:company|group|fiscal|fy|financial|year|quarter|current|next|coming|period)\b))(?:the\s+)?[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b"
BOOK_PART_AFTER = r"^\s*(?:of|for|in)\s+(?:the|its|our)?\s*(?:company['’]s\s+)?[\w&\s]{0,30}?\b(?:business|division|segment|vertical)\b"
BOOK_SUBSIDIARY = r"\bsubsidiar(?:y|ies)\b"
BOOK_WITH_SUBSIDIARY = r"(?:including|with|along\s+with)\s+(?:its\s+)?subsidiar|consolidated"
BOOK_OTHER_ENTITY = r"\b(?:entity|arm|jv|joint\s+venture)\b[^.]{0,25}$"
BOOK_WHOLE = r"\b(?:total|overall|consolidated)\b"
BOOK_CLOSING = r"\bto\s+(?:a\s+record\s+(?:of\s+)?|approximately\s+|approx\.?\s+|about\s+|nearly\s+|over\s+|around\s+|~\s*)?$"
BOOK_COMPARED = r"\b(?:compared|relative|as\s+against|against|versus|vs\.?)\s+(?:to\s+)?(?:\w+\s+)?$"
BOOK_LABEL_GAP = r"[\s:\-–(]*(?:(?:total|consolidated|unexecuted|outstanding|current|healthy|robust|strong|record|executable|open|confirmed)\s+)*"
BOOK_CONNECTIVES = ["comprising", "of", "with", "and", "including", "against", "vs", "versus", "increasing", "up", "from", "to", "which", "where"]
# A break is also a bullet as PDF text has it, a letter of private use.
BOOK_BREAK = r"\.\s+(?=[A-Z“\"(₹\uf000-\uf8ff])|\.\s*\n|[•●▪■◆❖➢✓►\uf000-\uf8ff]|\s\|\|\s|\n\s*\n|;\s+|\s\?\s(?=[A-Z])|\so\s(?=[A-Z])|\s›\s"
# A question mark that stands where the rupee sign was lost.
BOOK_LOST_RUPEE = r"(?<![\w?])\?\s?(?=\d[\d,]*(?:\.\d+)?\+?\s*(?:cr|crore|lakh|lac|mn|bn)\b)"
BOOK_DATES = {
    "dmy": r"\b(?P<d>\d{1,2})(?:st|nd|rd|th)?[\s\-/.,]*(?P<m>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?[\s\-/.,’']*(?P<y>20\d{2}|\d{2})\b",
    "mdy": r"\b(?P<m>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>20\d{2})\b",
    "num": r"\b(?P<d>\d{1,2})[./-](?P<m>\d{1,2})[./-](?P<y>20\d{2})\b",
    "qfy": r"\bQ(?P<q>[1-4])\s*(?:FY\s*)?['’]?(?P<fy>20\d{2}(?:\s*[-–]\s*\d{2,4})?|\d{2})\b",
    "my": r"\b(?P<m>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?[\s,’']+(?P<y>20\d{2}|\d{2})\b",
    "me": r"\b(?P<m>jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[\s-]+end\b",
}
BOOK_YEARS = r"\bFY\s*['’]?\d{2,4}(?:\s*[-–]\s*\d{2,4})?\b|\b20\d{2}(?:\s*[-–]\s*\d{2,4})?\b"
BOOK_DATE_CUE = r"\b(?:as\s+(?:on|of|at)|ended|ending|till|until|upto|up\s+to|on|at\s+the\s+end\s+of|closed\s+the\s+quarter|for\s+the\s+(?:year|quarter))[\s:,]*$"
BOOK_DATE_OWNER = r"[\s,]*(?:\(?\s*(?:as\s+(?:on|of|at)|on|at|till|upto)\s*)?[\s,:]*"
BOOK_TODAY = r"\bas\s+(?:on|of)\s+(?:date|today)\b|\btill\s+date\b|\bto\s+date\b|\bnow\b|\bcurrent(?:ly)?\b|\bpresent\b"
BOOK_YEAR_END = r"\b(?:closed|end(?:ed)?)\s+(?:of\s+)?the\s+(?:financial\s+)?year\b|\bfor\s+the\s+year\b|\bat\s+the\s+end\s+of\s+fy"
BOOK_QUARTER = r"\bquarter\b|\bQ[1-4]\b|\bH[12]\b"
# Confidence of a reading, and what is added to or taken from it.
BOOK_POINTS = {"closing": 0.82, "opening": 0.7, "bound": 0.72, "loose": 0.55, "label": 0.5, "over 40 letters": -0.15, "over 70 letters": -0.25, "whole": 0.08, "part": -0.2, "dated": 0.08}
# Letters: how far a figure may stand behind and before its anchor, and what is looked at around both.
BOOK_REACH = {"behind": 190, "between": 130, "before": 60, "context before": 40, "context behind": 60, "lead": 28, "measure": 70, "inflow": 40, "row": 18, "conversion": 25, "scope": 45, "next word": 28, "region": 40, "cue": 24, "owned": 45, "sentence": 1600, "forward": 80, "change": 50}
# Rating of dates: points off for a cue, points on for another figure between or in front, and the most that counts; days before the filing.
BOOK_DATE_POINTS = {"cue": -300, "other figure": 2000, "most": 400, "dateline": -100}
BOOK_DATE_DAYS = {"cued": 550, "plain": 200, "ahead": 1, "dateline": 2}
BOOK_LEAST_INR, BOOK_MOST_INR = 1e6, 2e13
BOOK_CONFIDENCE = (0.05, 0.97)
MONTH = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
ABBREVIATIONS = ["rs", "approx", "no", "nos", "mr", "ms", "mrs", "dr", "ltd", "pvt", "co", "inc", "st", "viz", "vs", "sr", "jr", "ref", "sec", "reg", "regn", "u.s", "e.g", "i.e", "etc", "fig", "corp", "bros", "govt", "dept", "est", "excl", "incl"]

# Statements that an order was received.
RECEIPT_NOUN = r"(?:(?:purchase|work|supply|service|export|repeat|new|pilot)\s+)?(?:orders?|contracts?|letters?\s+of\s+(?:award|intent|acceptance|commencement)|lo[ai]s?|lol|notifications?\s+of\s+award|awards?\s+of\s+contract)"
RECEIPTS = [
    r"\b(?:received|receives|secured|secures|bags|won|wins|obtained|awarded)\b[^.;:?]{0,140}?\b" + RECEIPT_NOUN + r"\b",
    r"\b" + RECEIPT_NOUN + r"\b[^.;:?]{0,80}?\b(?:has|have|was|were)\s+been\s+(?:received|awarded|placed|issued)\b",
    r"\breceipt\s+of\s+(?:an?\s+|the\s+)?" + RECEIPT_NOUN + r"\b",
    r"\b" + RECEIPT_NOUN + r"\s+(?:received|secured|won)\b",
    r"\b(?:contract|order)\s+wins?\b",
]
RECEIPT_VETO_BEFORE = r"\bwhether\b|\bif\s+yes\b|\bnot\b"
RECEIPT_VETO_AFTER = r"\bapproval\b|\bregional\s+director|\bregistrar\b|\btribunal\b|\bcourt\b|\bshow\s+cause|\bsebi\b|\bstock\s+exchange|\bpenalt|\bassessment\b|\bincome[\s-]+tax\b|domestic\b[^.;]{0,40}\binternational"
RECEIPT_PENDING = r"\b(?:after|upon|on|subject\s+to|pending|awaiting|until|till|before|expecting|expected)\s+(?:the\s+)?$"
LOWEST_BIDDER = r"\bemerge[sd]?\s+as\s+(?:the\s+)?(?:single\s+)?(?:lowest\s+bidder|l-?1)\b|\blowest\s+bidder\b|\bl-?1\s+bidder\b|\bdeclared\s+(?:as\s+)?l-?1\b"
ORDER_CATEGORIES = ["bagging/receiving of order", "receipt of order", "awarding of order"]
# What introduces and what ends the object of an order.
OBJECT_LEAD = r"\b(?:for\s+the\s+purpose\s+of|pertain(?:s|ing)\s+to|relating\s+to|in\s+respect\s+of|towards|for)\s+"
OBJECT_STOP = r",?\s+(?:amounting|worth|valued|aggregating|totall?ing|having|dated|vide|which|who|subject\s+to|pursuant\s+to|inclusive|exclusive|excluding|as\s+per|at\s+a\s+(?:total|value|cost)|for\s+a\s+(?:total|period|value|consideration)|to\s+be\s+(?:executed|completed|delivered)|with(?:in)?\s+(?:a\s+)?(?:period|stipulated|completion|timeline)|within\s+\d|on\s+or\s+before|from\s+the\s+date|from\s+m/s|from\s+[A-Z])|\s*[(,]?\s*(?:\brs\.?|\binr|\busd|\brupees|₹)\s*[\d.,]|\s*;|\.\s"
OBJECT_JUNK = r"\b(?:your\s+(?:kind\s+)?(?:information|reference|records?|perusal)|information\s+and\s+records?|(?:quarter|half[- ]year|month|year|period)\s+ended|financial\s+year|regulation\s*30|sebi|listing\s+obligations|disclosure|annexure|intimation|compliance|the\s+above|the\s+following|the\s+same|stock\s+exchange|payment|loans?|borrow\w*)\b"
# A sign or letter that stands where a scan lost the rupee sign.
RUPEE_DAMAGE = r"(?i)(?:(?<!\d)[%~¢=?]|(?<![\w.,])[ntz])\s?\d[\d,]*(?:\.\d+)?\s*(?:lacs?|lakhs?|crores?)\b"
# Rows of a disclosure table in running text: labels of the work, of who awards it, and what opens the next row.
TABLE_WORK = r"\b(?:nature\s+of\s+(?:the\s+)?order|significant\s+terms\s+and\s+conditions\s+of)\b"
TABLE_ENTITY = r"\bname\s*(?:\(\s*s\s*\))?\s+of\s+the\s+entity\b"
TABLE_NEXT = r"\b(?:whether|time\s+period|broad\s+consideration|name\s*(?:\(\s*s\s*\))?\s+of\s+the\s+entity|any\s+other|nature\s+of|significant\s+terms)\b|\s\d{1,2}\s*[.)]\s|\s[a-h]\s*[.)]\s"
TABLE_WORDS = r"\border\s*\(\s*s\s*\)\s*/?\s*|\bcontract\s*\(\s*s\s*\)\s*[;,]?|\(\s*s\s*\)\s*/?|\bawarding\s+the\b|\bawarded\s*,?\s*(?:in\b\s*)?(?:brief\s*;?)?|\bin\s+brief\s*;?|\bsignificant\s+terms\s+and\s+conditions\s+of\b"
TABLE_SAYS_NOTHING = r"^(?:as\s+per|general|the\s+contract\s+is\s+governed|commercial|domestic|international|not\s+applicable|not\s+disclosed|n\.?a\.?\b|nil|confidential|standard|usual|the\s+company|particulars|details|letter\s+of|terms\s+and\s+conditions|yes|no\b|fixed\s+(?:cost|price)|lump\s*-?\s*sum|item\s+rate|percentage\s+rate)"
# A filing's own title, and titles that say nothing.
TITLE_QUOTED = r"\btitled\s+\"([^\"]{15,220})\""
TITLE_INFORMED = r"\bhas\s+informed\s+the\s+exchange\s+(?:about|regarding)\s+(.{15,240}?)(?:\.\s|\.?$)"
TITLE_GENERIC = r"^(?:the\s+)?(?:bagging|receiving|awarding|announcement|intimation|disclosure|press\s+release|updates?\b|general\s+updates?|outcome|submission|regulation|reg\.?\s*30|please\s+find|with\s+reference|a\s+press\s+release|receipt\s+of\s+(?:purchase\s+|work\s+)?orders?\s*[:.-]?\s*$)"
# Names that are no customer, and where a long phrase may be cut.
CUSTOMER_JUNK = r"\b(?:schedule|regulations?|para|listing|sr\.?\s*no|sebi|annexure|circular)\b|\b(?:worth|rs\.?|crores?|lakhs?|for\s+the)\b|\d{3,}"
LEGAL_TAIL = r"(?:[\s,]+(?:private|pvt\.?))?[\s,]+(?:limited|ltd\.?|llc|plc|inc\.?|gmbh|ltda)\.?$"
PHRASE_BREAKS = r"(?:, | for | under | at | in | from | including | through | with | as | via )"
#: What an order of a kind is called, by the firmness of its phrase.
ORDER_NOUNS = {0.60: "Letter of Intent", 0.40: "lowest bid (L1)", 0.30: "MoU"}
