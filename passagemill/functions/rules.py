"""Rule tables of the guards. The operators that apply them are in ``operators.guards`` and ``operators.validate``."""

_GAP = r"(?:\d\.\d|[^.!?\n])"  # up to the end of a sentence, decimals included

# Patterns of text that tries to steer a model, by name, in this order.
INJECTION = {
    "override_prior": r"(?i)\b(?:ignore|disregard|forget|discard)\b[^.!?\n]{0,40}?\b(?:previous|prior|above|earlier|preceding|all|any)\b[^.!?\n]{0,20}?\b(?:instruction|prompt|rule|direction|message)s?\b",
    "override_output": r"(?i)\b(?:ignore|disregard|forget)\b[^.!?\n]{0,30}?\b(?:everything|all)\b[^.!?\n]{0,20}?\byou(?:'ve| have)? been told\b",
    "reveal_system": r"(?i)\b(?:reveal|show|print|repeat|output|display)\b[^.!?\n]{0,30}?\b(?:system|initial|original|hidden)\b[^.!?\n]{0,10}?\b(?:prompt|instructions?|message)\b",
    "role_reassign": r"(?i)\byou\s+are\s+now\b|\bnew\s+(?:system\s+)?(?:instruction|persona|role)s?\b|\bact\s+as\s+(?:a|an|the)\b",
    "jailbreak_persona": r"(?i)\b(?:developer\s+mode|dan\s+mode|jailbreak|do\s+anything\s+now)\b",
    "fake_turn_marker": r"(?i)(?:<\|?\s*(?:im_start|im_end|system|endoftext)\s*\|?>|\[/?INST\]|<<<\s*SYS\s*>>>|\b###\s*(?:instruction|system)\s*:)",
    "prompt_leak_request": r"(?i)\bwhat\s+(?:were|are)\s+your\s+(?:original\s+)?(?:instructions?|system\s+prompt|guidelines)\b",
    "citation_spoof": r"(?i)\b(?:cite|source|according\s+to)\s*:\s*https?://",
}

# What makes a question a request for advice, for performance, or for what no page holds, in this order.
ADVICE = {
    "buy_sell_hold": rf"(?i)\b(?:should\s+i|would\s+you|which\s+one\s+should|is\s+it\s+a\s+good|good\s+time\s+to)\b{_GAP}{{0,40}}?\b(?:buy|sell|invest|hold|redeem|switch|exit|allocate|start)\b",
    "recommendation": r"(?i)\b(?:recommend(?:ation|ed)?|suggest(?:ion|ed)?|advise|advice|best\s+(?:fund|scheme|option|choice)|top\s+pick|worth\s+investing|good\s+investment)\b",
    "risk_suitability": r"(?i)\b(?:fits?\s+my|suit(?:s)?\s+me|suit(?:able)?\s+for\s+(?:me|my)|safe\s+for\s+(?:me|my)|should\s+i\s+be\s+(?:in|invested|allocated)|right\s+for\s+me|risk\s+profile)\b",
    "comparison": rf"(?i)\b(?:better|best|versus|vs\.?|compare[sd]?|comparison|outperform\w*)\b{_GAP}{{0,50}}?\b(?:fund|scheme|elss|equity|small\s+cap|large\s+cap|balanced)\b",
    "evaluative": rf"(?i)\b(?:expense\s+ratio|exit\s+load|entry\s+load|ter\b|fees?|charges?)\b{_GAP}{{0,30}}?\b(?:high|low|expensive|cheap|too\s+high|too\s+low|good|bad|worth|fair|unfair|competitive|overpriced|underpriced)\b",
}
PERFORMANCE = {
    "returns_and_cagr": r"(?i)\b(?:cagr|annualized?\s+return|average\s+return|rolling\s+return|yearly\s+return|returns?\s+(?:of|since|over|for)|has\s+it\s+(?:out)?performed)\b",
    "performance_words": r"(?i)\b(?:performance|perform(?:ed|s|ing)?|how\s+did\s+it\s+do|worst\s+drawdown|drawdown|volatility|sharpe|sortino|alpha|beta|benchmark\s+return|beat\s+the\s+benchmark|outperform(?:ed|ing)?)\b",
    "nav": r"(?i)\bnav\b",
    "fund_aum_growth": r"(?i)\b(?:aum|assets?\s+under\s+management)\b(?=[\s\S]*\b(?:grown|grew|growing|risen|increased|increased\s+over|growth\s+of|has\s+it\s+(?:grown|increased|risen))\b)",
    "growth_projection": r"(?i)\b(?:what\s+will\s+i\s+(?:get|earn|receive|make)|how\s+much\s+(?:will|would)\s+i\s+(?:get|earn|have)|i\s+will\s+(?:get|earn)\b|final\s+value|maturity\s+(?:value|amount|benefit)|worth\s+after)\b",
    "bare_return_noun": r"(?i)\b(?:returns?|cagr)\b(?![\s\S]{0,15}?\b(?:period|load|ratio|amount|fee|charge|tax|window)\b)",
}
ABSENT = {
    "statements_documents": r"(?i)\b(?:capital\s+gains?|consolidated|account)\s+statement\b|\bstatement(?:s)?\s+(?:download|generate|get|fetch)\b|\bdownload\s+(?:my\s+|the\s+)?(?:statements?|report|tax\s+document|documents?)\b|\b(?:tax\s+)?statement\s+(?:for\s+)?(?:fy\s*)?\d{4}\b|\bhow\s+do\s+i\s+(?:get|download|generate)\b[^.!?\n]{0,30}?\bstatement\b",
    "personal_account_data": r"(?i)\b(?:my\s+(?:folio|holdings?|portfolio|sip|account|nav|investments?)|folio\s+number|switch\s+from\s+folio|update\s+my\s+(?:bank|mandate|details?)|change\s+my\s+(?:bank|address|email|phone))\b",
    "account_operations": r"(?i)\b(?:register|registration|open\s+(?:an?\s+)?account|nominee|add\s+nominee|terminate|closure|grievance|complaint|toll\s+free|customer\s+care)\b",
    "process_timing": rf"(?i)\b(?:when\s+(?:will|does|is|are)\b{_GAP}{{0,40}}?\b(?:credit|process|refund|settle|allot|confirm)\b|\bhow\s+long\s+does\b{_GAP}{{0,30}}?\b(?:take|settlement)\b)",
    "tax_computation": r"(?i)\bhow\s+much\s+tax\b|\btax\s+savings?\b|\btax\s+benefit\b|\bsection\s+80[cd]\b|\bhow\s+much\s+can\s+i\s+save\b",
}
# A name of a fund in running text; words that make a question one about facts of funds.
FUND_MENTION = r"\b((?:[A-Z][A-Za-z0-9'\-]*\s+){0,5}[A-Z][A-Za-z0-9'\-]*\s+Fund)\b"
TOPICS = r"(?i)\b(?:expense\s+ratio|exit\s+load|entry\s+load|loads?\b|minimum\s+(?:sip|investment|amount)|sip\b|lock[\s\-]?in|riskometer|risk\s+ometer|risk\s+category|benchmark|fund\s+manager|who\s+manages|sebi\b|direct[\s\-]?growth|charges?\b|fees?\b|ter\b|nav\b|aum\b|tax\b|contact\s+detail|toll[\s\-]?free|switch\b|units?\b|minimum\b|maximum\b)\b"

# Identifiers in text, the most specific first, and the words that tell long numbers apart.
IDENTIFIERS = {
    "email": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "pan": r"(?i)\b[A-Z](?:[\s\-]?[A-Z]){4}[\s\-]?[0-9](?:[\s\-]?[0-9]){3}[\s\-]?[A-Z]\b",
    "aadhaar": r"\b[2-9][0-9]{3}(?:[\s\-]?[0-9]{4}){2,3}\b",
    "otp": r"(?i)\b(?:otp|one[\s\-]?time|verification|passcode|pin)\b\D{0,20}\b[0-9]{4,6}\b",
    "ifsc": r"\b[A-Z]{4}0[A-Z0-9]{6}\b",
}
LONG_NUMBERS = (r"\b[0-9]{10,}\b", r"(?:\+?91[\s\-.]?)?\b[6-9][0-9]{4}[\s\-]?[0-9]{5}\b")
ACCOUNT_WORDS = r"(?i)\b(?:bank\s+account|account|acct|a\s*/\s*c)\b"
PHONE_WORDS = r"(?i)(?:\+\s?91\b|\b(?:phone|mobile|call|contact|whats?app|tel|telephone)\b)"
NUMBER_WORDS = r"(?i)\b(?:number|no\.)\b"
NUMBER_WINDOW, NATIONAL_DIGITS = 32, 10

# Claims of return in an answer, words that make a percentage a fee or a return, and how far they reach.
RETURN_CLAIMS = (
    r"(?i)\b(?:cagr|annualized?\s+return|average\s+return|rolling\s+return|yearly\s+return|returns?\s+(?:are|of|is|was|since|over|for|and)\b)",
    r"(?i)\b(?:outperform(?:ed|s|ing)?|underperform(?:ed|s|ing)?|beat\s+the\s+(?:benchmark|index|nifty)|topped\s+the\s+benchmark)\b",
    r"(?i)\b(?:performance\s+has|performance\s+is|performance\s+of|strong\s+performance|weak\s+performance|good\s+performance|poor\s+performance|consistent\s+performance)\b",
    r"(?i)\b(?:gave|given|returns?|returned|returning|earning|earned|yielded|yielding|rose|risen)\b[^.!?\n]{0,25}?\d+(?:\.\d+)?\s*%",
    r"(?i)\b(?:in\s+\d+\s+years?|after\s+\d+\s+years?|your\s+(?:investment|money|wealth|sip)\s+will|you\s+will\s+(?:get|earn|have)|will\s+grow\s+to|grow\s+to\s+rs|become\s+rs\s*\d|double[sd]?\s+(?:in|within)|triple[sd]?\s+(?:in|within)|target\s+amount\s+of|expected\s+(?:returns?|value|growth)|projected\s+value|wealth\s+of|worth\s+rs\s*\d)\b",
    r"(?i)\b(?:guarantee[sd]?|risk[\s\-]?free|assured\s+returns?|safe\s+investment|will\s+not\s+lose)\b",
    r"(?i)\b(?:should\s+i|would\s+you|recommend|you\s+should|one\s+should|you\s+ought\s+to)\b[^.!?\n]{0,40}?\b(?:buy|sell|invest|hold|redeem|allocate|switch|start)\b",
)
FEE_WORDS = r"(?i)\b(?:expense\s+ratio|ter\b|total\s+expense|exit\s+load|entry\s+load|maintenance\s+charge|asset\s+management\s+fee|fees?|charges?)\b"
RETURN_WORDS = r"(?i)\b(?:return|returns|returned|returning|cagr|yield|yielded|grew|grown|growth|profit|profits|gains?|earned|appreciation|appreciated|surge[ds]?|rally|rallied|upside|performance)\b"
RETURN_WINDOW, FEE_WINDOW = 60, 40

# Questions on performance, and descriptions of pages that say nothing.
EXCLUDED_QUESTIONS = r"(?i)\breturns?\b|\bnav\b|\baum\b|\bperform\w*|\bhow much has\b[^?]*\bgrow|\bmoney multiplier\b|\branking\b"
PERFORMANCE_NOISE = r"(?i)\b(returns?|nav|navs|aum|aums|performance|rankings?|money multiplier|since inception|ytd)\b"
META_TEMPLATE = r"(?i)get latest|sip returns\s*&|invest in .* online with"

CATEGORY_LABELS = {"email": "email address", "pan": "PAN", "aadhaar": "Aadhaar number", "otp": "one-time code", "ifsc": "bank branch code", "account": "account number", "phone": "phone number"}

#: What a user reads for each kind of answer that is not factual; the wording is ours.
NOTICES = {
    "pii_notice": "Please leave out personal identifiers; facts from public pages are all that can be asked for here.",
    "refusal": "Only facts from public pages are given here, no advice.",
    "abstain": "The official pages do not hold an answer to that.",
    "perf_redirect": "Returns are neither stated nor compared here; see the official page.",
    "error": "No reliable answer could be made. Please ask in other words.",
}
CAVEAT = "The page was read some time ago, so check the details there."
