-- the replies are literal, and so are the outcomes that the ordered checks must give
SELECT * FROM (VALUES
  ('good', 'factual', 'ok', 'The exit load is 1%.', 'https://pages.example/a'),
  ('stale', 'factual', 'stale_source', 'One thing. Two things. The page was read some time ago, so check the details there.', 'https://pages.example/b'),
  ('long', 'factual', 'ok', 'One. Two of it. Three of it.', 'https://pages.example/a'),
  ('pii', 'pii_notice', 'output_pii:email', 'Please leave out personal identifiers; facts from public pages are all that can be asked for here.', ''),
  ('return', 'perf_redirect', 'c4_block:claim_3', 'Returns are neither stated nor compared here; see the official page.', 'https://pages.example/a'),
  ('percent', 'perf_redirect', 'c4_block:unexplained_percentage', 'Returns are neither stated nor compared here; see the official page.', 'https://pages.example/a'),
  ('unsourced', 'abstain', 'no_citation', 'The official pages do not hold an answer to that.', ''),
  ('refused', 'refusal', 'model_refused', 'Only facts from public pages are given here, no advice.', ''),
  ('elsewhere', 'abstain', 'citation_provenance_dropped:1', 'The official pages do not hold an answer to that.', ''),
  ('empty', 'abstain', 'empty_answer', 'The official pages do not hold an answer to that.', ''),
  ('broken', 'error', 'generation_parse_failed', 'No reliable answer could be made. Please ask in other words.', '')
) AS t(id, kind, reason, answer, sources)
