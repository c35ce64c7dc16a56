"""Word lists, patterns and constants that results depend on. Order matters where a first match wins."""

# fmt: off
# Lenders and their keywords; the first match in this order wins.
LENDERS = {
    "ACH CAPITAL": ["ACH CAPITAL"],
    "AFFIRM": ["AFFIRM", "AFFIRM PAY", "AFFIRM COM", "AFFIRM COM PAYME"],
    "BALBOA CAPITAL": ["BALBOA", "BALBOA CAPITAL"],
    "BITTY ADVANCE": ["BITTY", "BITTY ADVANCE", "MCA SAVINGS"],
    "BIZFUND": ["BIZFUND", "BIZFUND ACHDEBIT"],
    "BLUEVINE": ["BLUEVINE"],
    "BLACKBULL": ["BLACKBULL", "BLACKBULL ENTERP", "BLACKBULL WCTA"],
    "BREAKOUT CAPITAL": ["BREAKOUT", "BREAKOUT CAPITAL"],
    "CAN CAPITAL": ["CAN CAPITAL", "CANCAP", "CANACAP"],
    "CAPITAL INFUSION": ["CAP INFUSION", "CAPITAL INFUSION"],
    "CDC SMALL BUSINESS": ["CDC SMALL BUS", "CDC SMALL BUSINESS"],
    "CFGMS": ["CFGMS", "LCM", "LCM 1823095", "MC 844 662 3467", "CGF"],
    "CHANNEL PARTNERS": ["CHANNEL PARTNERS", "LENDING SERVICES"],
    "CLEARCO": ["CLEARCO"],
    "CREDIBLY": ["CREDIBLY", "RETAIL CAPITAL"],
    "DAILY FUNDING": ["DAILY FUNDING", "DAILYFUNDING"],
    "DE LAGE LANDEN": ["DE LAGE LANDEN", "DELAGELANDEN", "DIRECT DEB DELAGELANDEN"],
    "DELTA": ["DELTA", "FUNDRY"],
    "EBF HOLDINGS": ["EBF", "EBF DEBIT", "EBF HOLDINGS", "HOLDINGS EBF"],
    "ELEVATED FUNDING": ["ELEVATED", "ELEVATED FUNDING"],
    "EMINENT FUNDING": ["EMINENT", "3329001101", "EMINENT FUNDING"],
    "EMS HOLDINGS": ["EMS", "EMS HOLDINGS"],
    "EVEREST BUSINESS FUNDING": ["EVEREST", "EBFUNDING", "EVEREST BUSINESS FUNDING"],
    "EXPANSION CAPITAL": [
        "EXP CAPITAL", "EXPANSION CAPITA", "EXPANSION CAPITAL",
        "EXPANSION CAPITA FUNDING", "EXPANSION CAPITAL FUNDING",
        "Expansion Capita Funding 5769267", "ECG LLC",
    ],
    "FORA FINANCIAL": ["FORA", "FORA FINANCIAL"],
    "FORWARD FINANCING": ["FORWARD FINANCIN", "FORWARD FINANCING", "FORWARDFINANCIN", "FORWARD FINANCINFF"],
    "FUNDBOX": ["FUNDBOX"],
    "FUNDATION": ["FUNDATION"],
    "FUNDIFI": ["FUNDIFI", "FUNDFI", "FUNDFI CANADA", "FUNDFICANADA"],
    "FUNDWORKS": [
        "FW CAPITAL", "FWCAPITAL", "FUNDWORKS", "FUND WORKS",
        "THE FUNDWORKS", "THE FUND WORKS", "FUNDWORK", "FUND WORK",
        "FUNDOWRK", "FUNDOWRKS", "FUND WRKS", "FUNDWK",
        "ACH FUNDWORKS", "FUNDWORKS LLC", "THE FUNDWORKS LLC",
    ],
    "GLOBAL MERCHANT": ["EDI PYMNTS", "GBL MERCHANT", "GLOBAL MER", "GLOBAL MER EDI", "GLOBAL MERCHANT", "WALL"],
    "GREENBOX CAPITAL": ["GREENBOX", "GREENBOX CAPITAL"],
    "GFE": ["GFE", "UFCE", "UNITED FIRST", "GLOBAL FUNDING"],
    "HEADWAY CAPITAL": ["HEADWAY", "HEADWAY CAPITAL"],
    "HOUSE": ["HOUSE", "MRBIZCAP"],
    "IDEA FINANCIAL": ["IDEAFINANCIAL", "IDEA FINANCIAL"],
    "IOU FINANCIAL": ["IOU", "IOU FINANCIAL"],
    "IRUKA": ["IRUKA", "J&G", "ICG"],
    "J & A MARKETING": ["J & A MARKETING", "J A MARKETING", "J&A MARKETING"],
    "JRW CAPITAL": ["JRW CAPITAL", "JR CAPITAL LLC"],
    "KABBAGE": ["KABBAGE"],
    "KAPITUS": ["KAPITUS", "STRATEGIC FUNDING"],
    "LENDINI": ["LENDINI", "FUNDING METRICS"],
    "LENTEGRITY": ["LENTEGRITY", "LENTEGRITY BILLPAY"],
    "LG FUNDING": ["LG FUNDING", "LG FUNDING LLC"],
    "LIBERTAS FUNDING": ["LIBERTAS", "LIBERTAS FUNDING"],
    "LOANME": ["LOAN ME", "LOANME"],
    "MUDFLAP": ["MUDFLAP"],
    "NATIONAL FUNDING": ["NATIONAL FUNDING"],
    "NAVITAS CREDIT CORP": ["NAVITAS CREDIT CORP", "NAVITAS CREDIT C", "NAVITAS"],
    "NMEF": ["NMEF", "NMEF 2023 A"],
    "ONDECK": ["ON DECK", "ONDECK", "ENOVA"],
    "PAR FUNDING": ["PAR", "PAR FUNDING"],
    "PAYABILITY": ["PAYABILITY"],
    "PAYPAL WORKING CAPITAL": ["PAYPAL CAPITAL", "PAYPAL WORKING CAPITAL"],
    "QUARTERSPOT": ["QUARTER SPOT", "QUARTERSPOT"],
    "RAPID FINANCE": ["RAPIDFINANCE", "RAPID FINANCE", "RAPID", "SBFS"],
    "RELIANT FUNDING": ["RELIANT", "RELIANT FUNDING"],
    "RETRO ADVANCE": ["RETRO ADVANCE", "RETROADVANCE", "RETROADVANCEINC", "RETRO ADVANCE INC"],
    "SHEAVES": ["SHEAVES", "3201961 ONTARRIO INC", "11302078 CANADA LTD"],
    "SMARTPAY": ["SMARTPAY", "SMARTPAY SOL"],
    "SPECIALTY": ["SPECIALTY", "ASCENTRA VENTURE"],
    "SHOPIFY CAPITAL": ["SHOPIFY CAPITAL", "SHOPIFY CREDIT"],
    "SQUARE CAPITAL": ["SQ CAPITAL", "SQUARE CAPITAL"],
    "TORRO": ["TORRO"],
    "VELOCITY CAPITAL": ["VELOCITY", "VELOCITY CAPITAL"],
    "YELLOWSTONE CAPITAL": ["YELLOWSTONE", "YELLOWSTONE CAPITAL"],
    "2M7": ["2M7", "URAL LINK"],
}

# Names that look like lenders and aren't.
FALSE_LENDERS = [
    "SQ", "SQUARE", "PAYPAL", "PAY PAL", "STRIPE", "SNAP",
    "VENMO", "ZELLE", "CASHAPP", "INTUIT", "SHOPIFY",
    "CARD PURCHASE", "POS", "DEBIT CARD", "PURCHASE AUTHORIZED",
    "CLOVER", "TOAST",
]

# Fragments of descriptions that are always money in, always money out, or no transaction.
ALWAYS_CREDIT = [
    "EXPANSION CAPITA",
    "EXPANSION CAPITAL FUND",
    "RETRO ADVANCE INC",
    "J & A MARKETING",
    "J&A MARKETING",
    "CDC SMALL BUS",
    "BLACKBULL ENTERP",
    "00SAPP010",
]
ALWAYS_DEBIT = ["SHOPIFY CAPITAL DES", "SHOPIFY CREDIT DES", "CHECKCARD", "REFERENCE #"]
SKIPPED = ["REFERENCE #"]

# Patterns of funding deposits and of repayments.
FUNDING_DEPOSIT = [
    r"ACH\s*PAYMEN",
    r"ACH\s*ITEMS",
    r"ACH\s*DEPOSIT",
    r"ACH\s*CREDIT",
    r"FUNDING\s*DEPOSIT",
    r"LOAN\s*PROCEED",
    r"LOAN\s*DEPOSIT",
    r"MCA\s*FUND",
    r"ADVANCE\s*DEPOSIT",
    r"FUNDED",
    r"WIRE\s*IN",
    r"INCOMING\s*WIRE",
    r"WIRE\s*TRANSFER\s*INCOMING",
    r"PY\d{2}/\d{2}/\d{2}",
    r"00SAPP010",
    r"CAPITA\s+FUNDING",
    r"CAPITAL\s+FUNDING",
    r"FUNDING\s+\d{5,}",
    r"ADVANCE\s+INC",
    r"SALE\s+\d{6}",
    r"EXPANSION\s+CAPITA",
]
DEBIT_ONLY = [
    r"\bBILLPAY\b",
    r"\bBILL\s*PAY\b",
    r"\bPAYMENT\b",
    r"\bPMT\b",
    r"\bREPAY\b",
    r"CCD\s+DEBIT",
    r"ACH\s+DEBIT",
    r"PURCHASE\s+AUTH",
    r"\bCHECKCARD\b",
    r"SHOPIFY\s+CAPITAL\s+DES",
    r"SHOPIFY\s+CREDIT\s+DES",
    r"\bDES:",
    r"\bINDN:",
    r"\bID:RPP",
    r"\bID:XXXXXXXXX",
    r"\bCO\s+ID:",
    r"\s+CCD$",
]

# Prefixes that a description may lose before it is matched.
PREFIXES = r"^(CCD\s*DEBIT[,\s]*|ACH\s*DEBIT[,\s]*|ACH\s*PMT[,\s]*|WIRE\s*TRANSFER\s*INCOMING[,\s]*|TRANSFER\s*INCOMING[,\s]*)"

# Returned-item, loan and point-of-sale patterns.
NSF = [r"\bNSF\b", r"\bNSF\s+FEE\b", r"NON.SUFFICIENT\s+FUNDS", r"INSUFFICIENT\s+FUNDS", r"OVERDRAFT\s+FEE", r"RETURNED\s+ITEM\s+FEE", r"RETURN\s+FEE", r"ITEMS?\s+RETURNED\s+UNPAID"]
NSF_FLAG = [r"\bnsf\b", r"nsf\s+fee", r"non.sufficient\s+funds", r"insufficient\s+funds", r"overdraft\s+fee", r"returned\s+item\s+fee", r"return\s+fee", r"items?\s+returned\s+unpaid", r"returned\s+unpaid"]
LOAN = [r"\bLOAN\b", r"\bMORTGAGE\b", r"\bMORTG\b", r"\bLINE\s+OF\s+CREDIT\b", r"\bLOC\s+(?:PMT|PYMT|PAY)\b", r"\bSBA\b"]
POS = [r"\bCARD\s+PURCHASE\b", r"\bCHECKCARD\b", r"\bPOS\b", r"\bINTERAC\s+PURCHASE\b", r"\bDEBIT\s+CARD\s+PURCHASE\b", r"\bPOINT\s+OF\s+SALE\b"]

# Words of sections, accounts and lines of generic statements.
CHECKING_SECTION_KEYWORDS = [
    "checking", "checking account",
    "business plus ckg", "business plus ckf",
    "business plus checking", "business plus", "ckg",
]
SAVINGS_SECTION_KEYWORDS = ["savings", "business savings"]
EXCLUDED_REVENUE_WORDS = ["transfer from shares", "refund", "reversal"]
CREDIT_SECTION_WORDS = [
    "DEPOSITS AND ADDITIONS",
    "DEPOSITS AND OTHER CREDITS",
    "DEPOSITS/CREDITS",
    "DEPOSITS AND CREDITS",
    "CREDITS TO YOUR ACCOUNT",
    "OTHER CREDITS",
    "CREDIT",
]
DEBIT_SECTION_WORDS = [
    "ELECTRONIC WITHDRAWALS",
    "ELECTRONIC PAYMENTS",
    "PAYMENTS",
    "WITHDRAWALS AND OTHER DEBITS",
    "ATM & DEBIT CARD WITHDRAWALS",
    "ATM AND DEBIT CARD WITHDRAWALS",
    "CHECKS PAID",
    "CHECKS/DEBITS",
    "DEBITS TO YOUR ACCOUNT",
    "OTHER WITHDRAWALS",
    "SERVICE FEES",
    "SERVICE CHARGES",
    "CCD DEBIT",
    "ACH DEBIT",
    "DEBIT",
    "WITHDRAWAL",
    "PAYMENT",
]
SKIP_LINE_KEYWORDS = [
    "BEGINNING BALANCE", "ENDING BALANCE", "ENDING DAILY BALANCE",
    "ACCOUNT NUMBER", "ROUTING NUMBER", "STATEMENT PERIOD", "PAGE ",
    "SUMMARY OF CHECKS", "MONTHLY SERVICE FEE",
    "SERVICE CHARGE DESCRIPTION", "TOTAL DEPOSITS", "TOTAL WITHDRAWALS",
    "TOTAL ELECTRONIC WITHDRAWALS", "TOTAL ATM", "TOTAL CHECKS", "TOTAL FEES",
]

# Words that tell the direction of an unsigned amount.
DEBIT_WORDS = [
    "debit", "withdrawal", "withdraw", "purchase", "pos", "atm", "check",
    "payment", "ach debit", "fee", "charge", "payroll", "transfer out",
    "zelle payment", "cash app", "square capital", "loan payment", "mca",
    "funding payment", "returned item", "overdraft",
]
CREDIT_WORDS = [
    "deposit", "credit", "ach credit", "merchant deposit", "stripe",
    "square deposit", "paypal deposit", "transfer in", "zelle deposit",
]

# Header names, first match wins.
DATE_ALIASES = ["date", "transaction date", "posted date"]
DESC_ALIASES = ["description", "details", "transaction", "memo"]
AMOUNT_ALIASES = ["amount", "transaction amount"]
DEBIT_ALIASES = ["debit", "debits", "withdrawal", "withdrawals", "money out"]
CREDIT_ALIASES = ["credit", "credits", "deposit", "deposits", "money in"]
HEADER_PARTS = [("Date", ["date"]), ("Description", ["description", "memo", "details"]), ("Debit", ["withdrawal", "debit"]), ("Credit", ["deposit", "credit"]), ("Amount", ["amount"])]

# Keywords of flagged lines, first match wins.
FLAGGED = ["SQ", "SQUARE", "PAYPAL", "PAY PAL", "STRIPE", "SHOPIFY", "INTUIT", "CLOVER", "TOAST"]

# Long labels and their short forms, replaced one after the other.
SHORT_FORMS = {
    "DIRECT DEPOSIT": "DEPOSIT",
    "INTERAC TRANSFER": "TRANSFER",
    "WIRE IN": "TRANSFER",
    "POS PURCHASE": "PURCHASE",
    "ATM WITHDRAWAL": "WITHDRAWAL",
    "PREAUTHORIZED DEBIT": "PREAUTHORIZED DEBIT",
    "SERVICE FEE": "FEE",
    "NSF FEE": "NSF",
    "ONLINE TRANSFER": "TRANSFER",
    "WIRE TRANSFER": "TRANSFER",
    "OVERDRAFT": "OVERDRAFT",
    "INTEREST": "INTEREST",
}

# Money tokens, date starts, month names, weeks in a month.
MONEY = r"-?\$?\d{1,3}(?:,\d{3})*\.\d{2}|-?\$?\d+\.\d{2}"
DATE_START = r"^(\d{1,2}/\d{1,2}(?:/\d{2,4})?|\d{1,2}\s+[A-ZÉÈÊÀÂÎÏÔÛÙÇÓÍÚÑ]{3,})\b"
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKS_PER_MONTH = 4.33

# Daily-balance sections, what ends them, printed averages and what disqualifies them.
BALANCE_SECTIONS = [
    r"DAILY\s+ENDING\s+BALANCE",
    r"DAILY\s*BALANCE\s*SUMMARY",
    r"Daily\s*ledger\s*balances",
    r"END(?:ING)?\s+BALANCE\s+SUMMARY",
    r"SOLDE\s+DE\s+FIN\s+DE\s+JOURN[EÉ]E",
]
BALANCE_STOP = (
    r"SERVICE\s+CHARGE\s+(?:SUMMARY|DETAIL)"
    r"|SERVICE\s+FEE\s+SUMMARY"
    r"|FRAIS"
    r"|INTEREST\s+CHARGE"
    r"|ACCOUNT\s+SUMMARY"
    r"|SAVINGS\s+SUMMARY"
    r"|#\d{3,}"
)
BALANCE_LIST_STOP = r"SERVICE\s+CHARGE|SERVICE\s+FEE|FRAIS|INTEREST\s+CHARGE|ACCOUNT\s+SUMMARY"
BALANCE_TAGS, TORN_BALANCE = r"(?i)\*(?:start|end)\*[^\n]*\n?", r"-?[\d,]{4,}\.\d{2}"
AVERAGE_NOT_AFTER = [
    "TRACE", "REFERENCE", "ACCOUNT", "ROUTING",
    "CHECK #", "CARD", "ID #", "PHONE", "AUTHORIZED",
]
PRINTED_AVERAGES = [
    r"Average\s*[Ll]edger\s*[Bb]alance\s+\$?[\d,]+\.?\d*\s+(-?\$?[\d,]+\.?\d+)",
    r"Average\s*[Ll]edger\s*[Bb]alance\s*\$?\s*(-?[\d,]+\.?\d+)",
    r"Average\s*[Dd]aily\s*[Bb]alance\s*\$?\s*(-?[\d,]+\.?\d*)",
    r"Average\s*[Cc]ollected\s*[Bb]alance\s*\$?\s*(-?[\d,]+\.?\d*)",
    r"Average\s*[Aa]vailable\s*[Bb]alance\s*\$?\s*(-?[\d,]+\.?\d*)",
    r"Average\s*[Cc]losing\s*[Bb]alance\s*\$?\s*(-?[\d,]+\.?\d*)",
    r"Solde\s*moyen\s*\$?\s*(-?[\d,]+\.?\d*)",
    r"Average\s*\w+\s*[Bb]alance\s*\$?\s*(-?[\d,]+\.?\d*)",
    r"MONTHLY\s+AVER\w*\.?\s+CR\.?\s+BAL\.?\s+\$?\s*(-?[\d,]+\.?\d*)",
]

# A daily balance, a dated line with a balance at its end, and words of lines that are no balances.
DAILY_PAIR = r"(\d{1,2}/\d{1,2}(?:/\d{2,4})?)\s+\$?(-?[\d,]+\.\d{2})"
DAILY_ROW = r"^(\d{1,2}/\d{1,2}(?:/\d{2,4})?).*?(-?\$?[\d,]+\.\d{2})\s*$"
DAILY_SKIPPED = ["TOTAL", "BALANCE FORWARD", "OPENING", "CLOSING", "BEGINNING", "SERVICE FEE", "ITEMS RETURNED", "AVERAGE", "MINIMUM"]
BEGINNING_BALANCE, ENDING_BALANCE = r"Beginning\s+balance\s+on\s+(\d{1,2}/\d{1,2})\s+(-?\$?[\d,]+\.?\d+)", r"Ending\s+balance\s+on\s+(\d{1,2}/\d{1,2})"
RUNNING_BALANCES = r"Ending\s+daily\s+balance|Ending\s+balance|Running\s+balance"

# Row layouts of single banks.
OCR_ROW = r"(\d{1,2}/\d{1,2}(?:/\d{2,4})?|\d{1,2}\s+[A-ZÉÈÊÀÂÎÏÔÛÙÇÓÍÚÑ]{3,})\s+(.*?)\s+\$?(-?[\d,\s]+\.\d{2}|-?[\d\s]+,\d{2})"
OCR_CREDIT_WORDS = ["DEPOSITS AND CREDITS", "OTHER CREDITS", "CREDITS", "CREDIT"]
OCR_DEBIT_WORDS = ["CHECKS AND CHARGES", "ELECTRONIC DEBITS", "OTHER DEBITS", "CHECKS/DEBITS", "DEBITS", "DEBIT", "WITHDRAWALS", "WITHDRAWAL", "PAYMENT"]
CHASE_CREDIT_HEADERS = ["DEPOSITS AND ADDITIONS"]
CHASE_DEBIT_HEADERS = ["CHECKS PAID", "ATM & DEBIT CARD WITHDRAWALS", "ATM AND DEBIT CARD WITHDRAWALS", "ELECTRONIC WITHDRAWALS", "FEES", "SERVICE FEES", "OTHER WITHDRAWALS"]
CHASE_STOP = r"^(DAILY\s+ENDING\s+BALANCE|SERVICE\s+CHARGE\s+(SUMMARY|DETAIL)|SAVINGS\s+SUMMARY|TRANSACTION\s+DETAIL)"
CHASE_CREDIT = r"DESCR:DEPOSIT|DEPOSIT\s+\d|ONLINE\s+TRANSFER\s+FROM|INTEREST\s+PAYMENT|WIRE\s+IN\b"
CHASE_SKIP = r"^(Total\b|Subtotal\b|Monthly\s+Service\s+Fee\b|Other\s+Service\s+Charges\b|Will\s+be\s+assessed\b|As\s+an\s+added\s+benefit\b)"
CHASE_BALANCE_ROW = r"^\d{1,2}/\d{1,2}(?:/\d{2,4})?\s+\$?\d[\d,]*\.\d{2}\b"
CAPITAL_ONE_CREDIT = r"TRANSFER\s+DEPOSIT|DEBIT\s+CARD\s+MONEY\s+RECEIVED|\bDEPOSIT\b"
CAPITAL_ONE_AMOUNT = r"\(?\$?([\d,]+\.\d{2})\)?"
CAPITAL_ONE_SKIP = r"DEPOSITS/CREDITS|WITHDRAWALS/DEBITS|RESULTING\s+BALANCE|SERVICE\s+CHARGE|TOTAL\s+NSF|TOTAL\s+OVERDRAFT|THANK\s+YOU|MEMBER\s+FDIC|CAPITAL\s+ONE|MANAGE\s+YOUR\s+CASH|CASH\s+MANAGEMENT|PAGE\s+\d+\s+OF\s+\d+|CONTINUED\s+FOR\s+PERIOD|PSI:\s*\d"
BOFA_HEADERS = [("DEPOSITS AND OTHER CREDITS", "Credit"), ("WITHDRAWALS AND OTHER DEBITS", "Debit"), ("CHECKS", "Debit"), ("SERVICE FEES", "Debit")]
TD_ON, TD_OFF = r"DAILY\s*ACCOUNT\s*ACTIVITY", r"DAILY\s*BALANCE\s*SUMMARY|HOW\s*TO\s*BALANCE"
TD_CREDIT_HEADER = r"^(DEPOSITS?(\s|$|\()|ELECTRONIC\s*DEPOSITS?|OTHER\s*CREDITS?)"
TD_DEBIT_HEADER = r"^(CHECKS?\s*PAID|ELECTRONIC\s*PAYMENTS?|OTHER\s*WITHDRAWALS?|SERVICE\s*CHARGES?)"
TD_NOISE = r"CALL\s*1-800|FDIC\s*INSURED|EQUAL\s*HOUSING|TD\s*BANK,?\s*N\.?A\.?|AMERICA.?S\s*MOST\s*CONVENIENT|^(Page\s*:|Statement\s*Period\s*:|Cust\s*Ref|Primary\s*Account|xxxxxx)|POSTING\s*DATE|SUBTOTAL|^DATE.*(SERIAL|AMOUNT)"
TD_CANADA_SKIP = r"(?i)^(BALANCE\s+FORWARD|DESCRIPTION|0\s+CHQS|NEXT\s+STATEMENT|MONTHLY\s+AVER|MONTHLY\s+MIN|DEP\s+CONTENT|Credits\b|Debits\b|NO\.\s*AMOUNT)"
TD_CANADA_CREDIT = r"\bTFR-FR\b|\bMSP\b"
TD_CANADA_DEBIT = r"\bTFR-TO\b|\bSEND\s+E-TFR\b|\bFEE\b|\bPAYMENT\b|\bCHARGE\b|\bINTEREST\b|\bWITHDR"
RBC_SKIP = r"opening\s*balance|closing\s*balance|account\s*fees?|account\s*activity\s*details"
RBC_CREDIT = r"ATM\s*deposit|e-Transfer\s*received|Online\s*transfer\s*received|Misc\s*Payment\s*MRCH\d+|Cheque\s*returned|Item\s*returned|Web\s*payment\s*BIZFUND\s*CA\s*LTD"
RBC_DEBIT = (
    r"Monthly\s*fee|Regular\s*transaction\s*fee|ATM\s*cash\s*deposited\s*fee|In\s*branch\s*cash\s*deposited\s*fee|NSF\s*item\s*fee|Online\s*Banking\s*payment|Online\s*Banking\s*transfer"
    r"|e-Transfer\s*sent|Online\s*transfer\s*sent|Cheque\s*-\s*\d|Interac\s*purchase|Contactless\s*Interac|Bill\s*Payment|Insurance|Equipment\s*Rent|Business\s*PAD"
    r"|Misc\s*Payment\s*Fundfi|Misc\s*Payment\s*BIZFUND\s*ACHDEBIT|Misc\s*Payment\s*2313833|Misc\s*Payment\s*PAY-FILE|Misc\s*Payment\s*Canacap"
)
RBC_TABLE_SKIP = ["opening balance", "closing balance", "account fees", "account activity details"]
RBC_MERCHANT = r"Misc\s*Payment\s*MRCH\d+"
TD_CHECKS = r"(\d{2}/\d{2})\s+(\d+\*?)\s+([\d,]+\.\d{2})"
REGIONS_CREDIT_HEADER, REGIONS_DEBIT_HEADER = r"^DEPOSITS\s*&?\s*CREDITS\b", r"^(WITHDRAWALS|FEES)\b"
REGIONS_BOX_CREDIT, REGIONS_BOX_DEBIT, REGIONS_BOX_DATE = r"^DEPOSITS\b", r"^(WITHDRAWALS|FEES)\b", r"^\d{1,2}/\d{1,2}$"
REGIONS_STOP = r"^Total\s+(Deposits|Withdrawals|Overdraft|Returned|For\s+This|Calendar)"
REGIONS_ROW = r"^(\d{1,2}/\d{1,2})\s+(.+?)\s+\$?(-?[\d,]+\.\d{2})\s*$"
CHARGE_ROW = r"^(\d{1,2}/\d{1,2})\s+(.+?)\s+(-?\$?\d{1,3}(?:,\d{3})*\.\d{2}|-?\$?\d+\.\d{2})"

# What names a bank: alternatives, of each of which all patterns must match; banks are tried in this order.
BANKS = [
    ("Chase", [[r"\bJPMORGAN\b|\bCHASE\b", r"THROUGH"]]),
    ("Bank of America", [[r"BANK\s+OF\s+AMERICA", r"DEPOSITS\s+AND\s+OTHER\s+CREDITS"]]),
    ("TD Bank", [[r"\bTD\s*BANK\b", r"ELECTRONIC\s*DEPOSITS", r"ELECTRONIC\s*PAYMENTS"], [r"TORONTO[\-\s]DOMINION\s*BANK", r"CHEQUE.{0,10}DEBIT"]]),
    ("Wells Fargo", [[r"WELLS\s+FARGO"]]),
    ("RBC", [[r"\bRBC\b|ROYAL\s+BANK\s+OF\s+CANADA|RBCROYALBANK|CHEQUES?\s*[&＆]\s*DEBITS?"]]),
    ("US Bank", [[r"U\.?S\.?\s*BANK"]]),
    ("PNC", [[r"\bPNC\s*BANK\b|\bPNC\b"]]),
    ("Capital One", [[r"CAPITAL\s+ONE"]]),
    ("Regions", [[r"REGIONS\s+BANK|LIFEGREEN|REGIONS\.COM|REGIONSMORTGAGE|REGIONS\s+DEPOSIT|BANKING\s+WITH\s+REGIONS"]]),
]
# The Canadian layout of TD, by its name or by its column heads.
CANADA_TRUST = r"TORONTO[\-\s]DOMINION\s*BANK|TD\s+CANADA\s+TRUST|^(?=.*CHEQUE.{0,5}DEBIT)(?=.*DEPOSIT.{0,5}CREDIT)(?=.*BUSINESS\s+CHEQU)"

# Labels of a summary. Each side is a list of alternatives; an alternative's patterns are added up. The last
# group is the amount, an earlier one the count. "first" takes the first match of a pattern, "each" all, "once" all that differ.
SUMMARIES = {
    "Chase": ("once", [[r"Deposits\s+and\s+Additions\s+\$?([\d,]+\.\d{2})"]], [[r"ATM\s*&?\s*Debit\s+Card\s+Withdrawals\s+\$?([\d,]+\.\d{2})", r"Electronic\s+Withdrawals\s+\$?([\d,]+\.\d{2})", r"Checks\s*Paid\s+\$?([\d,]+\.\d{2})", r"Service\s+Fees?\s+\$?([\d,]+\.\d{2})", r"Other\s+Withdrawals\s+\$?([\d,]+\.\d{2})", r"^Fees\s+\d+\s+-?([\d,]+\.\d{2})", r"Total\s+Fees\s+\$?([\d,]+\.\d{2})"]]),
    "Bank of America": ("first", [[r"Deposits\s+and\s+other\s+credits\s*(?:\(\d+\))?\s*-?\s*\$?\s*([\d,]+\.\d{2})"]], [[r"Withdrawals\s+and\s+other\s+debits\s*(?:\(\d+\))?\s*-?\s*\$?\s*([\d,]+\.\d{2})", r"\bChecks\s*(?:\(\d+\))?\s*(?:\(\d+\))?\s*-?\s*\$?\s*([\d,]+\.\d{2})", r"Service\s+fees?\s*(?:\(\d+\))?\s*-?\s*\$?\s*([\d,]+\.\d{2})"]]),
    "TD Bank": ("each", [[r"(?<!Electronic )(?<!Other )(?<!\w)Deposits\s+\$?([\d,]+\.\d{2})", r"Electronic\s*Deposits\s+\$?([\d,]+\.\d{2})", r"Other\s*Credits\s+\$?([\d,]+\.\d{2})"]], [[r"Checks\s*Paid\s+\$?([\d,]+\.\d{2})", r"Electronic\s*Payments\s+\$?([\d,]+\.\d{2})", r"Other\s*Withdrawals\s+\$?([\d,]+\.\d{2})", r"Service\s*Charges?\s+\$?([\d,]+\.\d{2})"]]),
    "TD Canada": ("each", [[r"Credits.*?(\d{1,3})(?!\.\d{2})\s+([\d,]+\.\d{2})"]], [[r"Debits.*?(\d{1,3})(?!\.\d{2})\s+([\d,]+\.\d{2})"]]),
    "Wells Fargo": ("first", [[r"(\d+)\s+Deposits\s*/?\s*Credits\s+\$?\s*([\d,]+\.\d{2})"], [r"Deposits\s*/?\s*Credits\s+\$?\s*([\d,]+\.\d{2})"]], [[r"(\d+)\s+Checks\s*/?\s*Debits\s+\$?\s*([\d,]+\.\d{2})"], [r"(?:Withdrawals|Checks)\s*/?\s*Debits\s*-?\s*\$?\s*([\d,]+\.\d{2})"]]),
    "RBC": ("first", [[r"deposits\s*[&＆]\s*credits\s*\((\d+)\).*?\+\s*([\d,]+\.\d{2})"], [r"deposits\s*[&＆]\s*credits\s*\((\d+)\).*?(?<!\d)([\d,]+\.\d{2})"], [r"deposits\s+and\s+credits\s*\((\d+)\).*?\+\s*([\d,]+\.\d{2})"], [r"deposits\s*[&＆and]+\s*credits.*?([\d,]+\.\d{2})"]], [[r"cheques?\s*[&＆]\s*debits?\s*\((\d+)\).*?-\s*([\d,]+\.\d{2})"], [r"cheques?\s*[&＆]\s*debits?\s*\((\d+)\).*?(?<!\d)([\d,]+\.\d{2})"], [r"checks?\s+and\s+debits?\s*\((\d+)\).*?-\s*([\d,]+\.\d{2})"], [r"cheques?\s*[&＆and]+\s*debits?.*?([\d,]+\.\d{2})"]]),
    "US Bank": ("first", [[r"(\d+)\s+Deposits\s*/?\s*Credits\s+\$?\s*([\d,]+\.\d{2})"], [r"Total\s+(?:Deposits?\s*/?|)Credits?\s+\$?\s*([\d,]+\.\d{2})"]], [[r"(\d+)\s+(?:Checks|Withdrawals)\s*/?\s*(?:Debits)?\s+\$?\s*([\d,]+\.\d{2})"], [r"Total\s+(?:Withdrawals?\s*/?|)Debits?\s+\$?\s*([\d,]+\.\d{2})"]]),
    "PNC": ("first", [[r"(\d+)\s+Credit(?:s)?\s*(?:This\s+Period)?\s+\$?([\d,]+\.\d{2})"]], [[r"(\d+)\s+Debit(?:s)?\s*(?:This\s+Period)?\s+\$?([\d,]+\.\d{2})"]]),
    "Capital One": ("first", [[r"\d+\s+Deposits/Credits\s+\$?\s*([\d,]+\.\d{2})"], [r"Deposits\s*(?:/|and\s+(?:Other\s+)?)Credits\s+\$?\s*([\d,]+\.\d{2})"]], [[r"Checks/Debits\s+\(?\$?\s*([\d,]+\.\d{2})\)?", r"Service\s+Charges?\s+\(?\$?\s*([\d,]+\.\d{2})\)?"]]),
    "Regions": ("first", [[r"Deposits\s*&?\s*Credits\s+\$?\s*([\d,]+\.\d{2})"]], [[r"(?<![A-Za-z])(?<!Total\s)Withdrawals\s+\$?\s*([\d,]+\.\d{2})", r"(?<![A-Za-z])Fees\s+\$?\s*([\d,]+\.\d{2})", r"(?<![A-Za-z])Checks\s+\$?\s*([\d,]+\.\d{2})"]]),
}
SUMMARY_TOTALS = r"Totals?\s+\$?([\d,]+\.\d{2})\s+\$?([\d,]+\.\d{2})"

# Labels of summaries of unknown banks; of each side the largest amount counts.
GENERIC_CREDIT = [r"(\d+)\s+Deposits/Credits\s+([\d,]+\.\d{2})", r"()Deposits\s+and\s+other\s+credits\s+([\d,]+\.\d{2})", r"(\d+)\s+Credit\(s\)\s+This\s+Period\s+\$?([\d,]+\.\d{2})", r"()Deposits/Credits\s+\$?\s*([\d,]+\.\d{2})", r"()Totals\s+\$?([\d,]+\.\d{2})\s+\$?[\d,]+\.\d{2}", r"()Deposits\s+and\s+Additions\s+\$?([\d,]+\.\d{2})", r"()Total\s+des\s+d[ée]p[oô]ts.*?\+?\s*([\d\s]+,\d{2})", r"()Total\s+de\s+dep[oó]sitos.*?\+?\s*\$?([\d,\s]+\.\d{2}|[\d\s]+,\d{2})"]
GENERIC_DEBIT = [r"(\d+)\s+Checks/Debits\s+([\d,]+\.\d{2})", r"()Withdrawals\s+and\s+other\s+debits\s+([\d,]+\.\d{2})", r"(\d+)\s+Debit\(s\)\s+This\s+Period\s+\$?([\d,]+\.\d{2})", r"()Withdrawals/Debits\s*-?\s*\$?\s*([\d,]+\.\d{2})", r"()Totals\s+\$?[\d,]+\.\d{2}\s+\$?([\d,]+\.\d{2})", r"()ATM\s*&?\s*DEBIT CARD WITHDRAWALS\s+\$?([\d,]+\.\d{2})", r"()ELECTRONIC WITHDRAWALS\s+\$?([\d,]+\.\d{2})", r"()OTHER WITHDRAWALS\s+\$?([\d,]+\.\d{2})", r"()SERVICE FEES\s+\$?([\d,]+\.\d{2})", r"()Total\s+des\s+retraits.*?-?\s*([\d\s]+,\d{2})", r"()Total\s+de\s+retiros.*?-?\s*\$?([\d,\s]+\.\d{2}|[\d\s]+,\d{2})"]
SPECIAL_LAYOUT = [r"Deposits\s+and\s+Additions", r"ATM\s*&?\s*Debit\s+Card\s+Withdrawals|Electronic\s+Withdrawals|Checks\s+Paid"]
SPECIAL_CREDIT = [r"Deposits\s+and\s+Additions\s+\$?([\d,]+\.\d{2})", r"Electronic\s*Deposits\s+\$?([\d,]+\.\d{2})", r"Other\s*Credits\s+\$?([\d,]+\.\d{2})", r"(?<!Electronic )(?<!Other )(?<!\w)Deposits\s+\$?([\d,]+\.\d{2})"]
SPECIAL_DEBIT = [r"ATM\s*&?\s*Debit\s+Card\s+Withdrawals\s+\$?([\d,]+\.\d{2})", r"Electronic\s+Withdrawals\s+\$?([\d,]+\.\d{2})", r"Checks\s*Paid\s+\$?([\d,]+\.\d{2})", r"Electronic\s*Payments\s+\$?([\d,]+\.\d{2})", r"Other\s*Withdrawals\s+\$?([\d,]+\.\d{2})", r"Service\s+Fees?\s+\$?([\d,]+\.\d{2})"]

# Labels of summaries that are read line by line.
LINE_FIRST = [("DEPOSITS/CREDITS", "credit"), ("CHECKS/DEBITS", "debit")]
LINE_UNCOUNTED = [("DEPOSITS AND OTHER CREDITS", "credit"), ("WITHDRAWALS AND OTHER DEBITS", "debit")]
LINE_AMOUNT = r"(\d{1,3}(?:,\d{3})*\.\d{2}|\d+\.\d{2})"

# How statements print their numbers of transactions, and what tells the side of a row without one.
COUNTS_BOFA = [r"#\s*of\s*deposits/credits:\s*(\d+)", r"#\s*of\s*withdrawals/debits:\s*(\d+)", r"Total\s+#\s*of\s*checks\s+(\d+)"]
COUNTS_CHASE_CREDIT = [r"Deposits\s+and\s+Additions\s+(\d+)\s+[\d,]+\.\d{2}"]
COUNTS_CHASE_DEBIT = [r"Checks\s+Paid\s+(\d+)\s+-?[\d,]+\.\d{2}", r"ATM\s*&\s*Debit\s+Card\s+Withdrawals\s+(\d+)\s+-?[\d,]+\.\d{2}", r"Electronic\s+Withdrawals\s+(\d+)\s+-?[\d,]+\.\d{2}", r"Fees\s+(\d+)\s+-?[\d,]+\.\d{2}"]
COUNTS_TD_CREDIT = [("Deposits", "Electronic Deposits"), ("Electronic Deposits", "Other Credits"), ("Other Credits", "Checks Paid")]
COUNTS_TD_DEBIT = [("Electronic Payments", "Other Withdrawals"), ("Other Withdrawals", "Service Charges"), ("Service Charges", "DAILY BALANCE")]
COUNTS_TD_CHECKS, COUNTS_TD_CHECK_PART = r"Checks\s+Paid\s+No\.\s+Checks:\s*(\d+)", r"(Checks\s+Paid.*?(?:Electronic\s+Payments|Subtotal:))"
COUNTS_TOTAL = r"Subtotal|Total|Beginning Balance|Ending Balance"
WELLS_SKIP = ["BEGINNING BALANCE", "ENDING BALANCE", "DAILY BALANCE", "STATEMENT PERIOD", "TOTALS", "PAGE "]
WELLS_CREDIT = ["DEPOSIT", "ZELLE FROM", "PURCHASE RETURN", "REFUNDED", "ACH CREDIT", "CREDIT", "SALE", "DEPOSIT MADE", "INSTANT PMT FROM"]
WELLS_DEBIT = ["PURCHASE AUTHORIZED", "RECURRING PAYMENT", "ZELLE TO", "PAYMENT", "ACH DEBIT", "TRANSFER", "CHECK", "FEE", "WITHDRAWAL", "ACORNS", "VENMO", "PURCHASE"]
CAPITAL_ONE_NSF = r"NSF\s+(?:charge|fee)"

# States and their codes.
STATES = {
    'alabama':'AL','alaska':'AK','arizona':'AZ','arkansas':'AR',
    'california':'CA','colorado':'CO','connecticut':'CT','delaware':'DE',
    'florida':'FL','georgia':'GA','hawaii':'HI','idaho':'ID',
    'illinois':'IL','indiana':'IN','iowa':'IA','kansas':'KS',
    'kentucky':'KY','louisiana':'LA','maine':'ME','maryland':'MD',
    'massachusetts':'MA','michigan':'MI','minnesota':'MN','mississippi':'MS',
    'missouri':'MO','montana':'MT','nebraska':'NE','nevada':'NV',
    'new hampshire':'NH','new jersey':'NJ','new mexico':'NM','new york':'NY',
    'north carolina':'NC','north dakota':'ND','ohio':'OH','oklahoma':'OK',
    'oregon':'OR','pennsylvania':'PA','rhode island':'RI','south carolina':'SC',
    'south dakota':'SD','tennessee':'TN','texas':'TX','utah':'UT',
    'vermont':'VT','virginia':'VA','washington':'WA','west virginia':'WV',
    'wisconsin':'WI','wyoming':'WY','district of columbia':'DC',
}

# Labels of an application form by its part, and the fields they fill.
FORM_BUSINESS = {
    'business legal name':            'Business_Legal_Name',
    'doing business as (dba)':        'Doing_Business_As_DBA',
    'dba':                            'Doing_Business_As_DBA',
    'address':                        'Business_Address',
    'city':                           'Business_City',
    'state':                          'Business_State',
    'zip':                            'Business_Zip',
    'phone':                          'Business_Phone',
    'email':                          'Business_Email',
    'entity':                         'Entity_Type1',
    'type of entity':                 'Entity_Type1',
    'entity type':                    'Entity_Type1',
    'federal tax id':                 'Federal_Tax_ID',
    'business start date (mm/yyyy)':  'Date_Current_Ownership_Started',
    'date current ownership started': 'Date_Current_Ownership_Started',
}
FORM_PRINCIPAL = {
    'principle owner name':           'Principle_Owner_Name',
    'ownership %':                    'Principle_Ownership',
    'email':                          'Principle_Email',
    'phone':                          'Principle_Phone',
    'address':                        'Principle_Address',
    'city':                           'Principle_City',
    'state':                          'Principle_State',
    'zip':                            'Principle_Zip',
    'ssn':                            'Principle_SSN',
    'date of birth':                  'Principle_DOB',
}
FORM_SECONDARY = {
    'secondary owner name':           'Secondary_Owner_Name',
    'ownership %':                    'Secondary_Ownership',
    'email':                          'Secondary_Email1',
    'phone':                          'Secondary_Phone',
    'address':                        'Secondary_Address',
    'city':                           'Secondary_City',
    'state':                          'Secondary_State',
    'zip':                            'Secondary_Zip',
    'ssn':                            'Secondary_SSN',
    'date of birth':                  'Secondary_DOB',
}
FORM_PROPERTY = {
    'business description':                 'Industry_App',
    'industry':                             'Industry_App',
    'purpose of funds requested':           '_industry_fallback',
    'annual business revenue':              'Portal_Monthly_Rev',
    'estimated fico score':                 '_fico_raw',
    'requested advance amount':             'Requested_Funding_Amount',
    'average monthly credit card volume':   'Average_Monthly_Deposits',
}

# Values that are labels, or hold one.
FORM_LABEL = r"(?i)^(?:ownership\s*%?|email|city|state|zip(?:\s*code)?|ssn|date\s+of\s+birth|dob|phone|fax|address|website|suite(?:/floor)?|floor|landlord)\s*:?\s*$"
FORM_LABEL_INSIDE = r"(?i)\b(?:ownership|email|city|state|zip|ssn|phone|address)\s*:"
