"""SQL twins of the derived tables in ``docloom.sources.fixtures``."""

from __future__ import annotations

import re

VIEWS = {
    "fx_term": """SELECT * FROM (VALUES
 ('alpha','the','normal','en'),('alpha','there','normal','en'),('alpha','whst','broad','en'),
 ('beta','that','normal','en'),('beta','this','normal','en'),
 ('gamma','und','normal','de'),('gamma','der','normal','de'),
 ('delta','la','strict','fr'),('delta','dans','normal','fr'),
 ('omega','zzzqq','normal','en')) t(canonical,variant,strength,lang)""",
    "fx_node": """SELECT * FROM (VALUES
 ('RW',NULL,'RW','root rw'),('RW.A','RW','RW','node a'),('RW.A.X','RW.A','RW','leaf ax'),('RW.B','RW','RW','node b'),
 ('CP',NULL,'CP','root cp'),('CP.A','CP','CP','node a'),('COV',NULL,'COV','root cov'),('COV.A','COV','COV','cov a'),
 ('DEF',NULL,'DEF','root def'),('DEF.T','DEF','DEF','term'),('PAY',NULL,'PAY','root pay'),('REM',NULL,'REM','root rem'))
 t(taxonomy_id,parent_id,family,label)""",
    "fx_item_rule": """SELECT * FROM (VALUES
 (1,'there','RW.A'),(2,'whst','RW.A.X'),(3,'that','RW.B'),(4,'this','CP.A'),(5,'with','COV.A'),(6,'und','DEF.T'),(7,'la','PAY'),(8,'license','REM'))
 t(ord,needle,taxonomy_id)""",
    "fx_files0": """SELECT doc_id, substr(sha256('doc'||doc_id),1,16) AS file_key,
 CASE doc_id%8 WHEN 0 THEN 'SPA_signed_20210904_' WHEN 1 THEN 'SPA_buyer draft_' WHEN 2 THEN 'SHA_seller draft_'
  WHEN 3 THEN 'SSA_2nd markup_' WHEN 4 THEN 'MOU_final draft_' WHEN 5 THEN 'ATA_bidding_' WHEN 6 THEN 'SPA_Buyer 1st markup_' ELSE 'notes_' END||doc_id||'.docx' AS filename,
 source AS folder, lang, CAST(n_chars AS INT) AS char_count,
 CASE WHEN doc_id%50=49 THEN 'empty' WHEN doc_id%50=48 THEN 'error' WHEN doc_id%50=47 THEN 'missing' ELSE 'ok' END AS status,
 CASE WHEN doc_id%50=49 THEN 'pdf_text_empty' WHEN doc_id%50=48 THEN 'corrupt_docx' END AS error_reason,
 CASE WHEN doc_id%10<3 THEN 'pilot_001' ELSE 'full_001' END AS batch_label,
 CASE doc_id%8 WHEN 7 THEN 'unclassified' WHEN 2 THEN 'SHA' WHEN 3 THEN 'SSA' WHEN 4 THEN 'MOU' WHEN 5 THEN 'ATA/BTA' ELSE 'SPA' END AS ctype,
 CASE WHEN doc_id%8 IN (1,2,3,4,6) THEN 1 WHEN doc_id%8=0 THEN 0 END AS is_draft,
 CASE WHEN doc_id%8=0 THEN 'final' END AS version_hint,
 CASE doc_id%8 WHEN 0 THEN 'execution' WHEN 1 THEN 'buyer_draft' WHEN 2 THEN 'seller_draft' WHEN 3 THEN 'markup_unknown' WHEN 4 THEN 'execution' WHEN 5 THEN 'bidding' WHEN 6 THEN 'buyer_markup' ELSE 'unknown' END AS version_role,
 CASE doc_id%8 WHEN 3 THEN 'med' WHEN 4 THEN 'low' WHEN 7 THEN NULL ELSE 'high' END AS version_confidence,
 substr(sha256(text),1,16) AS content_hash FROM documents""",
    "fx_files": """SELECT *, folder||'/'||filename AS path,
 CASE WHEN status='ok' THEN min(CASE WHEN status='ok' THEN file_key END) OVER (PARTITION BY content_hash) ELSE file_key END AS dup_group FROM fx_files0""",
    "fx_paragraphs": """SELECT f.file_key, CAST(p.para AS INT) AS para, p.content FROM fx_files f JOIN
 (SELECT doc_id, unnest(string_split(text,chr(10))) AS content, generate_subscripts(string_split(text,chr(10)),1) AS para FROM documents) p USING(doc_id) WHERE f.status='ok'""",
    "fx_clause_item": """SELECT f.file_key, f.doc_id, r.taxonomy_id, split_part(r.taxonomy_id,'.',1) AS family,
 f.file_key||'-'||p.para||'-'||r.ord AS item_ref, p.content AS verbatim, p.para AS loc_start, CAST(p.para+(f.doc_id%3) AS INT) AS loc_end,
 CASE (f.doc_id+p.para)%4 WHEN 0 THEN 'affirmative' WHEN 1 THEN 'negative' WHEN 2 THEN 'none_exist' ELSE 'not_applicable' END AS statement_polarity,
 CASE WHEN f.doc_id%20=0 THEN 'stale' ELSE f.content_hash END AS txt_hash,
 CASE WHEN (f.doc_id+p.para)%9=0 THEN 'pending' WHEN (f.doc_id+p.para)%9=4 THEN 'needs_review' ELSE 'approved' END AS review_status
 FROM fx_files f JOIN fx_paragraphs p USING(file_key) JOIN fx_item_rule r ON contains(lower(p.content),r.needle)""",
    "fx_family": """SELECT * FROM (VALUES (0,'RW'),(1,'CP'),(2,'COV'),(3,'DEF'),(4,'PAY'),(5,'REM')) t(k,family)""",
    "fx_document_coverage": """SELECT f.file_key, g.family,
 CASE (f.doc_id+g.k)%5 WHEN 0 THEN 'partial' WHEN 1 THEN 'not_evaluated' ELSE 'complete' END AS body_status,
 CASE f.doc_id%3 WHEN 0 THEN 'no_annex' WHEN 1 THEN 'complete' ELSE 'partial' END AS annex_status,
 CASE WHEN f.doc_id%17=0 THEN 'stale' ELSE f.content_hash END AS txt_hash
 FROM fx_files f CROSS JOIN fx_family g WHERE f.status='ok' AND (f.doc_id+g.k)%11<>0""",
    "fx_source_coverage": """SELECT f.file_key, g.family, 'src-'||f.doc_id AS source_id, 'schedule' AS source_kind,
 CASE f.doc_id%3 WHEN 1 THEN 'complete' ELSE 'partial' END AS status,
 CASE WHEN f.doc_id%2=1 THEN substr(sha256('doc'||(f.doc_id+1)),1,16) END AS storage_file_key,
 CASE WHEN f.doc_id%13=0 THEN 'stale' WHEN f.doc_id%2=1 THEN coalesce(s.content_hash,'') ELSE f.content_hash END AS txt_hash
 FROM fx_files f JOIN fx_family g ON true LEFT JOIN fx_files s ON s.doc_id=f.doc_id+1 WHERE f.status='ok' AND f.doc_id%3<>0""",
    "fx_candidate": """SELECT f.doc_id*1000000+p.para AS candidate_id, f.file_key AS evidence_file_key, g.family,
 CASE WHEN f.doc_id%7=0 THEN g.family||'.A' ELSE g.family END AS recommended_parent_id, p.content AS verbatim, left(p.content,12) AS proposed_ko,
 p.para AS loc_start, 'pending' AS status, 1 AS document_count
 FROM fx_files f JOIN fx_paragraphs p USING(file_key) JOIN fx_family g ON g.k=f.doc_id%6""",
    "fx_doc_meta": """SELECT f.file_key, CASE WHEN f.doc_id%4=1 THEN 2 ELSE 3 END AS meta_schema_version,
 CASE WHEN f.doc_id%19=0 THEN 'stale' ELSE f.content_hash END AS txt_hash,
 CASE f.doc_id%3 WHEN 0 THEN 'high' WHEN 1 THEN 'med' ELSE 'low' END AS confidence,
 CASE WHEN f.doc_id%5=0 THEN '{"evaluated":false}' ELSE '{"evaluated":true,"items":[{"name":"'||f.folder||'","role":"buyer"}]}' END AS parties_json,
 CASE WHEN f.doc_id%6=0 THEN '{"evaluated":true,"amount_value":null}' ELSE '{"evaluated":true,"amount_value":'||(CAST(f.char_count AS BIGINT)*1000000)||',"payment_methods":["cash"],"currency":"KRW","confidence":"high"}' END AS consideration_json,
 '{"indemnity":{"present":'||CASE WHEN f.doc_id%4=2 THEN 'true' ELSE 'false' END||',"loc_start":1,"loc_end":2}'||CASE WHEN f.doc_id%9=0 THEN '' ELSE ',"law":{"present":true,"loc_start":2,"loc_end":2}' END||'}' AS clause_map_json
 FROM fx_files f WHERE f.status='ok' AND f.doc_id%4<>0""",
    "fx_answer_key": """SELECT b.item_id AS gt_id, f.file_key, b.text AS verbatim FROM benchmark b JOIN documents d ON contains(d.text,b.text) JOIN fx_files f USING(doc_id) WHERE f.status='ok'""",
    "fx_verdict": """SELECT f.file_key, CASE WHEN l.quality=1 THEN 'correct' ELSE 'incorrect' END AS verdict FROM labels l JOIN fx_files f USING(doc_id)""",
    "fx_query_log": """SELECT conv_id*100+turn AS id, lower(regexp_replace(split_part(text,' ',1),'[^a-zA-Z]','','g')) AS kw, CAST((conv_id+turn)%4 AS INT) AS result_count FROM conversations WHERE role='user'""",
}


def with_views(body: str) -> str:
    """``body`` with the derived tables that it names, directly or not, as CTEs before it."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\bfx_\w+", text):
            if name in VIEWS and name not in needed:
                need(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    need(body)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in needed)
    body = body.strip()
    if not ctes:
        return body
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {ctes},\n{re.sub(r'(?i)^with' + chr(92) + r's+recursive', '', body, count=1)}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{body}"
