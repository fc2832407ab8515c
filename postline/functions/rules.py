"""Term lists of the labelling rules, and how they become patterns.

A list holds alternatives, as regular-expression text; ``words`` puts them between word boundaries. Spark's engine reads a
pattern with ``JVM`` before it (case and boundaries by Unicode), DuckDB's with ``RE2`` (ASCII).
"""

from __future__ import annotations

JVM, RE2 = "(?iuU)", "(?i)"


def words(terms: str) -> str:
    """The terms (separated by white space at line ends and by `` | ``) between word boundaries."""
    return rf"\b({join(terms)})\b"


def join(terms: str) -> str:
    return "|".join(t.strip() for line in terms.strip().splitlines() for t in line.split(" | ") if t.strip())


# The terms of each role-family rule.
SOFTWARE = r"""
software | swe | sde | sdet | developer | programmer | full[\s-]?stack | back[\s-]?end | front[\s-]?end | devops | sre | cloud | kubernetes
machine learning | data (engineer|scientist) | firmware | embedded | java | python | golang | typescript | kotlin | scala
sql | postgres | mysql | oracle | hadoop | dba | sysadmin | api | backend | frontend
qa | test[\s-]?automation | robotics? | site[\s-]?reliability | server[\s-]?(engineer|administrator|side)
control[\s-]?plane | platform[\s-]engineer | infrastructure[\s-]engineer | web[\s-]?(developer|engineer|dev) | mobile[\s-]?(developer|engineer|app)
ios | android | linux | unix | docker | aws | azure | gcp | terraform | micro[\s-]?services? | distributed[\s-]systems? | compiler | observability
react | node\.?js | rust | ruby | perl | etl | data[\s-](platform|pipeline|scien\w*) | ai[\s-](scientist|engineer|research\w*) | data[\s-]scien\w*
"""
SYMBOL_LANGUAGES = r"\b(c\+\+|c#|\.net)"
NOT_TECHNICAL = r"""
nurse | nursing | rn | lpn | cna | physician | surgeon | pharmacist | dental | therapist | caregiver | patient care
phlebotom | radiolog | sonograph | veterinar | cashier | barista | server | busser | dishwasher | cook | chef | baker | butcher
retail | store associate | sales associate | stocker | merchandiser | driver | trucker | cdl | courier | warehouse | forklift | picker | packer
janitor | custodian | housekeep | groundskeep | landscap | teacher | tutor | professor | lecturer | substitute
security guard | police | firefighter | paramedic | plumber | electrician apprentice | hvac | welder | machinist | carpenter
field[\s-]?service[\s-]?technician | maintenance[\s-]?technician
"""
DISCIPLINE = r"""
mechanical | electrical | electro[\s-]?mechanical | electronics? | civil | structural | chemical | industrial | manufacturing | process
aerospace | aeronautical | astronautical | biomedical | bio[\s-]?medical | petroleum | mining | geological | geotechnical | environmental | environment
nuclear | agricultural | marine | automotive | materials | metallurg\w* | welding | packaging | corrosion | drilling | reservoir | thermal
optical | optics | acoustic | propulsion | hydraulic | pneumatic | fire[\s-]?protection | architectural | continuous[\s-]?improvement
facilities | maintenance | equipment | production | safety | quality | project | controls? | validation | calibration | metrology | supplier
service | plant | tooling | molding | moulding | textile | water | wastewater | highway | traffic | transportation | survey | hvac | piping
harness | vehicle | chassis | powertrain | battery | stress | fatigue | avionics | payload | mission[\s-]?operations | ground[\s-]?support
semiconductor | photonics | antenna | rf | wafer | fab | sustainability | utilities | energy | mep | geomatics
transmission | distribution | substation | construction | spacecraft | gnc | guidance | launch[\s-]?operations | flight[\s-]?test | design
"""
# The noun that a discipline stands near, and how near.
NOUN = r"(?:engineer\w*|intern(?:ship)?|co[\s-]?op)"
GAP = r"[\w\s/&,.'()–—·-]"
GAP_BEFORE_NOUN, GAP_AFTER_NOUN = 36, 24
ACADEMIC = r"""
adjunct | faculty | professor | lecturer | instructor | post[\s-]?doc\w* | post[\s-]?doctoral | tenure[\s-]?track
teaching[\s-]?(assistant|associate|fellow) | visiting[\s-]?scholar
"""
SALES = r"""
account[\s-]?(executive|manager) | business[\s-]?development | bdm | bdr
sales[\s-]?(rep(resentative)?|manager|director|specialist|associate|consultant|executive|lead|operations)
pre[\s-]?sales[\s-]?(specialist|consultant|manager|representative) | partner[\s-]?(development|manager) | channel[\s-]?(sales|partner|manager)
territory[\s-]?manager | inside[\s-]?sales | field[\s-]?sales | revenue[\s-]?operations
"""
FORWARD_DEPLOYED = r"""
forward[\s-]?deployed | solutions?[\s-]?(engineer|architect(ure)?) | sales[\s-]?engineer | field[\s-]?engineer | deployment[\s-]?engineer
implementation[\s-]?(engineer|consultant|specialist) | customer[\s-]?engineer | technical[\s-]?account[\s-]?(manager|executive) | partner[\s-]?engineer
developer[\s-]?advocate | technical[\s-]?consultant | deployment[\s-]?strategist | field[\s-]?(application|systems?)[\s-]?engineer
integration[\s-]?engineer | professional[\s-]?services[\s-]?(engineer|consultant)
"""
AI_STRONG = r"""
machine[\s-]?learning | deep[\s-]?learning | mlops | ml[\s-]?ops | reinforcement[\s-]?learning | computer[\s-]?vision
natural[\s-]?language[\s-]?processing | llm | large[\s-]?language[\s-]?model | generative[\s-]?ai | gen[\s-]?ai | genai
neural[\s-]?network | transformer[\s-]?model | applied[\s-]?scientist | research[\s-]?scientist | research[\s-]?engineer
"""
# The short name before or after a noun.
AI_BEFORE_NOUN = r"\b(ai|ml|nlp)[\s-]?(engineer|scientist|researcher|developer|architect|infrastructure|platform|systems?|ops)\b"
AI_AFTER_NOUN = r"\b(engineer|scientist|researcher|architect)[,\s-]+(ai|ml)\b"
ENGINEERING = r"""
software | swe | sde | engineer | engineering | developer | programmer | back[\s-]?end | front[\s-]?end | full[\s-]?stack
devops | sre | site reliability | platform | infrastructure | systems?[\s-]?engineer | embedded | firmware | hardware engineer | asic | fpga | silicon
mobile | ios | android | architect | technical lead | tech lead | qa engineer | test engineer | automation engineer
compiler | kernel | distributed systems | kubernetes | terraform | cloud engineer | cloud architect | graphics engineer | blockchain | smart contract
simulation engineer | game (engineer|developer|programmer) | sdet | quality assurance engineer | member of technical staff
java | python | golang | typescript | javascript | kotlin | scala | perl | ruby on rails | react[\s.]?js | react native | node[\s.]?js | angular | vue[\s.]?js
django | spring boot | hadoop | apache spark | snowflake | databricks | kafka | airflow | docker | jenkins | ansible | postgres | mysql | mongodb
sysadmin | systems? administrator | network (engineer|administrator) | dba | database administrator | aws | gcp
"""
# Further patterns of the same family.
ENGINEERING_MORE = (
    r"\brobotics?[\s-]?(engineer|software|developer|scientist|architect)\b",
    r"\b(software|systems?|controls?)[\s-]?engineer.{0,20}robotic",
    r"\bazure[\s-]?(engineer|developer|architect|administrator|cloud)\b",
    SYMBOL_LANGUAGES,
    r"\b(software|api|web|mobile|game|platform|firmware|embedded|full[\s-]?stack)[\s-]?development\b",
)
SECURITY = r"""
security engineer | appsec | infosec | application security | product security | offensive security | penetration[\s-]?test(er|ing)? | pentest(er)?
red team | blue team | ethical hack(er|ing)? | bug bounty | threat (intel|detection) | incident response | detection engineer | cryptograph
security research(er)? | network exploitation | reverse engineer(ing)? | malware | vulnerability[\s-]?(research(er)?|management)
security (analyst|architect|operations) | soc | siem | iam engineer | identity and access
"""
DATA = r"""
data (engineer|scientist|analyst|architect|scien(ce|tists?)) | analytics engineer | business intelligence | bi (developer|analyst)
quantitative[\s-]?(research(er)?|analy(st|tics)|develop(er|ment)?|trader|strategist|engineer) | quant | statistician | econometric
"""
PRODUCT = r"product manager | product owner | program manager | technical program manager | tpm | product management"
DESIGN = r"designer | design lead | ux | ui designer | user experience | user research | product design | visual design | brand design"
# Seniority levels, the first that matches.
SENIORITY = (
    ("intern", r"intern | internship | co[\s-]?op | placement student"),
    (
        "new_grad",
        r"new[\s-]?grad | graduate (program|scheme|engineer|developer) | entry[\s-]?level | early career | campus | university grad | junior | jr\.? | associate engineer | engineer i | level 1",
    ),
    ("executive", r"chief | cto | ceo | cio | ciso | vp | vice president | head of"),
    ("director", r"director | sr\.? director | senior director"),
    ("manager", r"manager | management"),
    ("principal", r"principal | distinguished | fellow | architect"),
    ("staff", r"staff | senior staff"),
    ("lead", r"lead | leader"),
    ("senior", r"senior | sr\.? | iii | iv | level 3 | l[45678]"),
)
# Places.
NON_TARGET_COUNTRY = r"""
india | singapore | china | hong kong | taiwan | japan | korea | vietnam | thailand | malaysia | indonesia | philippines | bangladesh | pakistan | sri lanka | nepal
australia | new zealand | canada | mexico | brazil | argentina | chile | colombia | peru | uruguay | costa rica | panama | guatemala | dominican republic | puerto rico
israel | turkey | türkiye | uae | united arab emirates | saudi | qatar | kuwait | bahrain | oman | jordan | lebanon | egypt | morocco | tunisia
south africa | nigeria | kenya | ghana | ethiopia | russia | kazakhstan | uzbekistan | georgia country | armenia | azerbaijan
"""
NON_TARGET_CITY = r"""
bengaluru | bangalore | hyderabad | pune | chennai | mumbai | bombay | new delhi | delhi | noida | gurgaon | gurugram | kolkata | ahmedabad | jaipur
kochi | coimbatore | thiruvananthapuram | trivandrum | indore | chandigarh | toronto | vancouver | montreal | montréal | ottawa | calgary | edmonton | waterloo, on
tel aviv | jerusalem | haifa | herzliya | tbilisi | batumi | kutaisi | yerevan | baku
mississauga | markham | kitchener | oakville | brampton | burnaby | richmond hill | halifax | winnipeg | saskatoon | regina | london, on | hamilton, ontario
tokyo | osaka | kyoto | yokohama | seoul | busan | shanghai | beijing | shenzhen | guangzhou | hangzhou | chengdu | suzhou | wuhan | taipei | hsinchu | kaohsiung
sydney | melbourne | brisbane | perth | canberra | adelaide | auckland | wellington | são paulo | sao paulo | rio de janeiro | belo horizonte | porto alegre
mexico city | ciudad de méxico | guadalajara | monterrey | buenos aires | santiago | bogot[áa] | lima | montevideo | san jos[ée], costa rica
dubai | abu dhabi | doha | riyadh | jeddah | cairo | casablanca | johannesburg | cape town | nairobi | lagos | accra
kuala lumpur | jakarta | manila | cebu | bangkok | ho chi minh | hanoi | dhaka | karachi | lahore | islamabad | colombo | kathmandu
"""
US_COUNTRY = r"\b(united states(?: of america)?|u\.?s\.?a\.?|usa)\b|(?:^|[,\-/(\s])us(?:$|[,\-/)\s])"
US_STATE = r"""
alabama | alaska | arizona | arkansas | california | colorado | connecticut | delaware | florida | hawaii | idaho | illinois | indiana | iowa | kansas | kentucky
louisiana | maine | maryland | massachusetts | michigan | minnesota | mississippi | missouri | montana | nebraska | nevada | new hampshire | new jersey | new mexico
new york | north carolina | north dakota | ohio | oklahoma | oregon | pennsylvania | rhode island | south carolina | south dakota | tennessee | texas | utah | vermont
georgia | virginia | west virginia | wisconsin | wyoming | district of columbia
"""
US_STATE_CODE = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC"
)
US_SHORTHAND = r"sf | sfo | nyc | nyc metro | bay area | socal | norcal | dmv | silicon valley | south bay | east bay | dtla"
CA_PROVINCE = r"""
ontario | quebec | québec | british columbia | alberta | manitoba | saskatchewan | nova scotia | new brunswick | newfoundland | labrador
prince edward island | yukon | nunavut | northwest territories
"""
EU_COUNTRY = r"""
united kingdom | england | scotland | wales | northern ireland | great britain | u\.?k\.? | ireland | france | germany | deutschland | spain | españa | portugal | italy
italia | netherlands | holland | belgium | luxembourg | switzerland | schweiz | suisse | austria | österreich | denmark | danmark | sweden | sverige | norway | norge
finland | suomi | iceland | poland | polska | czech(?:ia| republic)? | slovakia | slovenia | hungary | romania | bulgaria | greece | croatia | serbia | estonia | latvia
lithuania | ukraine | malta | cyprus | albania | bosnia | montenegro | north macedonia | moldova | monaco | andorra | liechtenstein | emea | europe | european union | eu
"""
US_CITY = r"""
san francisco | sf bay area | bay area | silicon valley | palo alto | mountain view | menlo park | sunnyvale | santa clara | san jose | cupertino | redwood city
oakland | berkeley | fremont | san mateo | foster city | emeryville | los angeles | santa monica | pasadena | irvine | san diego | sacramento
new york city | nyc | manhattan | brooklyn | queens | seattle | bellevue | redmond | kirkland | tacoma | austin | dallas | houston | san antonio | fort worth | plano | irving
chicago | evanston | naperville | boston | cambridge, ma | somerville | waltham | burlington, ma | lexington, ma | denver | boulder | colorado springs
atlanta | charlotte | raleigh | durham | research triangle | nashville | miami | orlando | tampa | jacksonville | philadelphia | pittsburgh | baltimore | arlington, va
reston | mclean | herndon | tysons | alexandria, va | minneapolis | st\.? paul | detroit | ann arbor | columbus | cleveland | cincinnati | indianapolis | kansas city
st\.? louis | milwaukee | omaha | des moines | phoenix | scottsdale | tempe | tucson | las vegas | reno | salt lake city | portland, or | beaverton | hillsboro
new orleans | memphis | louisville | oklahoma city | tulsa | albuquerque | boise | anchorage | honolulu | providence | hartford | stamford | princeton | newark
jersey city | hoboken | white plains | buffalo | rochester, ny | syracuse | albany, ny | madison, wi | iowa city | chapel hill | greenville | washington,? d\.?c\.?
silver spring | bethesda | rockville | penn state | college station | los gatos | santa cruz | san rafael | culver city | el segundo | torrance | carlsbad
westlake village | thousand oaks | chandler, az | mesa, az | morrisville | cary, nc | schaumburg | deerfield | framingham | marlborough | andover
king of prussia | malvern, pa | vancouver, wa
"""
EU_CITY = r"""
london | greater london | shoreditch | canary wharf | paris | île[\s-]de[\s-]france | lyon | toulouse | marseille | bordeaux | lille | nantes | nice | grenoble
strasbourg | montpellier | rennes | sophia antipolis | berlin | munich | münchen | hamburg | frankfurt | cologne | köln | stuttgart | düsseldorf | dusseldorf | dresden
leipzig | hannover | nuremberg | nürnberg | karlsruhe | heidelberg | darmstadt | walldorf | amsterdam | rotterdam | utrecht | eindhoven | the hague | den haag | delft
brussels | bruxelles | antwerp | antwerpen | ghent | leuven | madrid | barcelona | valencia | seville | sevilla | malaga | málaga | bilbao | zaragoza | lisbon | lisboa | porto
braga | milan | milano | rome | roma | turin | torino | bologna | florence | firenze | naples, it | zurich | zürich | geneva | genève | basel | bern | lausanne | lugano | zug
vienna | wien | graz | linz | salzburg | innsbruck | copenhagen | københavn | aarhus | odense | stockholm | gothenburg | göteborg | malmö | malmo | uppsala | lund
oslo | bergen | trondheim | stavanger | helsinki | espoo | tampere | oulu | reykjavik | reykjavík | warsaw | warszawa | krakow | kraków | cracow | wroclaw | wrocław
gdansk | gdańsk | poznan | poznań | katowice | lodz | łódź | prague | praha | brno | ostrava | bratislava | kosice | budapest | debrecen | bucharest | bucurești | cluj
timisoara | timișoara | iasi | sofia | plovdiv | varna | athens, gr | thessaloniki | zagreb | ljubljana | belgrade | beograd | novi sad | tallinn | tartu | riga | vilnius
kaunas | kyiv | kiev | lviv | kharkiv | dublin, ie | dublin, ireland | cork | galway | limerick | edinburgh | glasgow | aberdeen | belfast | cardiff | swansea
leeds | sheffield | liverpool | newcastle | nottingham | southampton | brighton | oxford | reading, uk | milton keynes | luxembourg | valletta | nicosia | monaco | andorra
"""
REMOTE = r"""
remote | hybrid | on[\s-]?site | anywhere | work[\s-]from[\s-]home | wfh | home[\s-]based | any location | flexible | virtual | distributed | worldwide | global
multiple locations | various | remoto | remoot | à distance | a distancia | teletrabajo | télétravail | fernarbeit | homeoffice | home office | op afstand | zdalnie | distansarbete
"""
# Three-letter country prefixes by region, and two-letter codes of Europe.
ISO3 = {
    "us": "usa",
    "europe": "gbr irl deu fra esp prt ita nld bel che aut swe nor dnk fin pol cze rou bgr grc hun ukr hrv srb est lva ltu svk svn lux mlt cyp isl",
    "other": "ind can chn jpn kor sgp aus nzl bra mex arg chl col zaf isr are sau tur rus vnm phl tha idn mys egy nga ken pak bgd lka hkg twn per crc cri",
}
EUROPE_CODES = "AL AD AT BY BE BA BG HR CY CZ DK EE FI FR DE GI GR HU IS IE IM IT XK LV LI LT LU MT MD MC ME NL MK NO PL PT RO RS SK SI ES SE CH UA GB VA FO GG JE AX SM"

# The patterns as the lists above make them, without a flag prefix.
SOFTWARE_RE = f"{words(SOFTWARE)}|{SYMBOL_LANGUAGES}"
_discipline = words(DISCIPLINE)
OTHER_ENGINEERING_RE = rf"{_discipline}{GAP}{{0,{GAP_BEFORE_NOUN}}}\b{NOUN}\b|\b{NOUN}\b{GAP}{{0,{GAP_AFTER_NOUN}}}{_discipline}"
AI_RE = "|".join((words(AI_STRONG), AI_BEFORE_NOUN, AI_AFTER_NOUN))
ENGINEERING_RE = "|".join((words(ENGINEERING), *ENGINEERING_MORE))
US_STATE_CODE_RE = rf"(?:^|,\s*|\s)({'|'.join(US_STATE_CODE.split())})(?:\s*$|\s*,)"
US_SHORTHAND_RE = rf"(?:^|[,\s/|-])({join(US_SHORTHAND)})(?:$|[,\s/|-])"
#: Families in order of decision, with (is_engineering, is_fde). The third element of a rule excuses a text that it matches.
FAMILIES: tuple[tuple[str, str, str | None], ...] = (
    ("other", words(ACADEMIC), None),
    ("fde", words(FORWARD_DEPLOYED), None),
    ("other", words(SALES), None),
    ("other", f"{words(NOT_TECHNICAL)}|{OTHER_ENGINEERING_RE}", SOFTWARE_RE),
    ("security", words(SECURITY), None),
    ("ai", AI_RE, None),
    ("data", words(DATA), None),
    ("engineering", ENGINEERING_RE, None),
    ("product", words(PRODUCT), None),
    ("design", words(DESIGN), None),
)
TECHNICAL = ("fde", "security", "ai", "data", "engineering")
