WITH cur AS (
  SELECT chunk_id, url FROM chunk WHERE snapshot_no = (SELECT max(snapshot_no) FROM chunk)
  QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY try_cast(fetched_at AS TIMESTAMPTZ) DESC NULLS LAST, url DESC NULLS LAST) = 1
)
SELECT chunk_id, regexp_matches(coalesce(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), ''), '(^|\.)(medium\.com|blogspot\.com|wordpress\.com|reddit\.com|quora\.com|youtube\.com|youtu\.be|wikipedia\.org|wikimedia\.org|linkedin\.com|twitter\.com|x\.com|facebook\.com|instagram\.com|substack\.com|tradingview\.com|moneycontrol\.com|etmoney\.com|zerodha\.com)$') AS denied FROM cur
WHERE regexp_replace(url, '/+$', '') IN (SELECT regexp_replace(url, '/+$', '') FROM source_list WHERE url IS NOT NULL)
