"""Schemas of the tables that the engine reads and writes."""

PAGE = "url string, title string, text string, category string, section string, date string, service_status string"
INDEX = (
    "pages array<struct<url:string,title:string,file:string,category:string,section:string,date:string,service_status:string>>, "
    "pdfs array<struct<url:string,file:string>>"
)
STATE = "url string, hash string, last_crawled string, title string, file string, changed boolean"
STATE_MAP = "map<string,struct<hash:string,last_crawled:string,title:string,file:string,changed:boolean>>"
CHUNK = (
    "text string, source string, title string, doc_type string, chunk_index int, chunk_total int, category string, section string, "
    "date string, service_status string, pdf_pages int, filename string"
)
STORE = f"chunk_id string, {CHUNK}, embedding array<float>"
SIDECAR = "title string, source_url string, category string"
GAP = "ts string, query string, chunks int"
FEEDBACK = "ts string, rating int, question string, answer_preview string"
TOKENS = "ts string, `in` long, `out` long, model string, cost double"
FACT = "keywords array<string>, require_any array<string>, text string, title string, source string, source_path string, category string"
OFFICE = "keywords array<string>, name string, path string, url string"
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"
