WITH q AS (SELECT DISTINCT id, question FROM pii_probes WHERE question IS NOT NULL)
SELECT id, 'personal_account_data' AS rule FROM q WHERE regexp_matches(question, '(?i)\b(?:my\s+(?:folio|holdings?|portfolio|sip|account|nav|investments?)|folio\s+number|switch\s+from\s+folio|update\s+my\s+(?:bank|mandate|details?)|change\s+my\s+(?:bank|address|email|phone))\b')
UNION ALL
SELECT id, 'account_operations' AS rule FROM q WHERE regexp_matches(question, '(?i)\b(?:register|registration|open\s+(?:an?\s+)?account|nominee|add\s+nominee|terminate|closure|grievance|complaint|toll\s+free|customer\s+care)\b')
UNION ALL
SELECT id, 'nav' AS rule FROM q WHERE regexp_matches(question, '(?i)\bnav\b')
UNION ALL
SELECT id, 'recommendation' AS rule FROM q WHERE regexp_matches(question, '(?i)\b(?:recommend(?:ation|ed)?|suggest(?:ion|ed)?|advise|advice|best\s+(?:fund|scheme|option|choice)|top\s+pick|worth\s+investing|good\s+investment)\b')
