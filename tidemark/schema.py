"""Schemas of the landed inputs and of the tables, in DDL: importing them needs no session."""




NSE_RAW = ("seq_id string, an_id string, symbol string, sm_name string, sm_isin string, smIndustry string, desc string, attchmntText string, attchmntFile string, an_dt string, exchdisstime string, is_sme boolean")
BSE_RAW = ("NEWSID string, SCRIP_CD string, SLONGNAME string, CATEGORYNAME string, SUBCATNAME string, HEADLINE string, NEWSSUB string, MORE string, ATTACHMENTNAME string, News_submission_dt string, DT_TM string, targeted boolean")
FILING = ("exchange string, native_id string, symbol string, bse_code string, company_name string, isin string, industry string, category string, subcategory string, headline string, body string, pdf_url string, filed_at timestamp, disseminated_at timestamp, is_sme boolean, targeted boolean")
ALERT = ("order_id string, channel string, ok boolean, sent_at timestamp")
FUNDAMENTALS = ("company_id string, q_revenue_inr double, ttm_revenue_inr double, ebitda_margin double, market_cap_inr double, source string, latest_quarter string, fetched_at timestamp, last_fy int, last_fy_revenue_inr double, last_fy_other_income_inr double, last_fy_pat_inr double")
MANUAL = ("key string, q_revenue_cr double, ttm_revenue_cr double, ebitda_margin double, market_cap_cr double, latest_quarter string")
