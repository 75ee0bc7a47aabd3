WITH n AS (SELECT doc_id, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)\b(?:ignore|disregard|forget|discard)\b[^.!?\n]{0,40}?\b(?:previous|prior|above|earlier|preceding|all|any)\b[^.!?\n]{0,20}?\b(?:instruction|prompt|rule|direction|message)s?\b') THEN 'override_prior' END, CASE WHEN regexp_matches(text, '(?i)\b(?:ignore|disregard|forget)\b[^.!?\n]{0,30}?\b(?:everything|all)\b[^.!?\n]{0,20}?\byou(?:''ve| have)? been told\b') THEN 'override_output' END, CASE WHEN regexp_matches(text, '(?i)\b(?:reveal|show|print|repeat|output|display)\b[^.!?\n]{0,30}?\b(?:system|initial|original|hidden)\b[^.!?\n]{0,10}?\b(?:prompt|instructions?|message)\b') THEN 'reveal_system' END, CASE WHEN regexp_matches(text, '(?i)\byou\s+are\s+now\b|\bnew\s+(?:system\s+)?(?:instruction|persona|role)s?\b|\bact\s+as\s+(?:a|an|the)\b') THEN 'role_reassign' END, CASE WHEN regexp_matches(text, '(?i)\b(?:developer\s+mode|dan\s+mode|jailbreak|do\s+anything\s+now)\b') THEN 'jailbreak_persona' END, CASE WHEN regexp_matches(text, '(?i)(?:<\|?\s*(?:im_start|im_end|system|endoftext)\s*\|?>|\[/?INST\]|<<<\s*SYS\s*>>>|\b###\s*(?:instruction|system)\s*:)') THEN 'fake_turn_marker' END, CASE WHEN regexp_matches(text, '(?i)\bwhat\s+(?:were|are)\s+your\s+(?:original\s+)?(?:instructions?|system\s+prompt|guidelines)\b') THEN 'prompt_leak_request' END, CASE WHEN regexp_matches(text, '(?i)\b(?:cite|source|according\s+to)\s*:\s*https?://') THEN 'citation_spoof' END) AS names FROM  documents)
SELECT * FROM n WHERE names <> ''
