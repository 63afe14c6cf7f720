"""Word lists and patterns of the language rules.

Fixed values: all below are data that results depend on, in their order.
"""

KEYWORDS = [
    "military", "defence", "defense", "army", "navy", "air force",
    "weapon", "missile", "aircraft", "fighter", "submarine",
    "border", "security", "terrorism", "insurgency", "counterterrorism",
    "strategic", "geopolitical", "diplomatic", "foreign policy",
    "LAC", "LOC", "line of control", "line of actual control",
    "exercise", "drill", "deployment", "patrol", "airstrike",
    "intelligence", "surveillance", "reconnaissance",
    "nuclear", "ballistic", "satellite", "cyber",
    "procurement", "contract", "deal", "acquisition",
    "general", "admiral", "marshal", "colonel", "brigadier",
    "minister", "ministry", "government",
]

# Topic: substrings of equipment names, keywords, countries.
TOPICS = {
    "Fighter Aircraft": {"equipment": ["rafale", "tejas", "mig", "su-30", "amca"]},
    "Missiles & Air Defence": {"equipment": ["brahmos", "agni", "prithvi", "aakash", "s-400"]},
    "Naval Assets": {"equipment": ["ins", "submarine", "aircraft carrier", "destroyer"]},
    "Drones & UAVs": {"equipment": ["drone", "uav", "predator", "heron"]},
    "Border Security": {"keywords": ["border", "lac", "loc"]},
    "Terrorism & Insurgency": {"keywords": ["terrorism", "insurgency"]},
    "Cybersecurity": {"keywords": ["cyber"]},
    "Nuclear Affairs": {"keywords": ["nuclear"]},
    "Military Exercises": {"keywords": ["exercise", "drill"]},
    "Defence Procurement": {"keywords": ["procurement", "contract", "deal"]},
    "Diplomatic Affairs": {"keywords": ["diplomatic", "foreign policy"]},
    "Space & Defence": {"keywords": ["satellite"]},
    "India-China Relations": {"countries": ["China"]},
    "India-Pakistan Relations": {"countries": ["Pakistan"]},
    "India-Russia Relations": {"countries": ["Russia"]},
    "India-US Relations": {"countries": ["United States", "USA"]},
}

EVENTS = {
    "Military Exercise": [
        r"\b(?:joint|bilateral|multilateral|naval|air|army|tri-service)\s+exercise\b",
        r"\bexercise\s+(?:yudh abhyas|malabar|varuna|garuda|indradhanush|sampriti|mitra shakti|shakti|dustlik|kazind|surya kiran|nomadic elephant)\b",
        r"\bmilitary drill\b",
        r"\bwar games?\b",
        r"\bfield training exercise\b",
    ],
    "Border Incident": [
        r"\b(?:border|lac|loc)\s+(?:clash|skirmish|standoff|face-off|transgression|incursion|friction)\b",
        r"\bceasefire violation\b",
        r"\bcross-border (?:firing|shelling)\b",
        r"\bunprovoked firing\b",
    ],
    "Counter-Terrorism Operation": [
        r"\b(?:encounter|anti-terror|cordon and search|combing)\s+operation\b",
        r"\bterrorists?\s+(?:neutralized|killed|apprehended|arrested)\b",
        r"\bgunfight broke out\b",
        r"\binfiltration bid (?:foiled|thwarted)\b",
    ],
    "Missile / Weapon Test": [
        r"\b(?:successful|flight)\s+test(?:ed|-fired)?\s+(?:of\s+)?(?:missile|torpedo|rocket|weapon system)\b",
        r"\btest-fired from\b",
        r"\buser trial (?:of|conducted)\b",
        r"\bflight-tested from (?:chandipur|abdul kalam island|itr|pokhran)\b",
    ],
    "Defence Procurement / Contract": [
        r"\b(?:dac|defence acquisition council|cabinet committee on security|ccs)\s+(?:approved|cleared)\b",
        r"\b(?:contract|deal|procurement|agreement|mou)\s+(?:signed|worth|valued at|inked)\b",
        r"\bacquisition of\s+(?:fighter|aircraft|missile|tank|drone|submarine|vessel|radar)\b",
        r"\bmake in india defence\b",
        r"\bindigenous development\b",
    ],
    "Diplomatic Meeting / Summit": [
        r"\b(?:bilateral|2\+2|quad|brics|sco|g20|summit|dialogue|talks)\s+(?:meeting|held|concluded)\b",
        r"\bforeign minister(?:s)?\s+meet(?:ing)?\b",
        r"\bdefence minister(?:s)?\s+meet(?:ing)?\b",
        r"\bdelegation level talks\b",
    ],
    "Troop / Asset Deployment": [
        r"\b(?:troops|forces|squadron|battalion|warship|submarine|jets)\s+(?:deployed|stationed|inducted|commissioned)\b",
        r"\bcommissioning of\s+ins\b",
        r"\binduction of\b",
    ],
    "Strategic Policy Announcement": [
        r"\b(?:national security|defence|foreign)\s+policy\s+(?:announced|unveiled|revised)\b",
        r"\bdefence budget (?:increased|allocated|presented)\b",
        r"\bstrategic partnership agreement\b",
    ],
}

LOCATION_TYPES = {
    "border_area": ["border", "loc", "lac", "line of control", "line of actual control", "frontier", "boundary", "fencing"],
    "military_installation": ["military base", "army base", "air force base", "naval base", "cantonment", "barracks", "garrison", "airfield", "airstrip", "military academy", "NDA", "IMA"],
    "strategic_infrastructure": ["highway", "road", "bridge", "dam", "port", "harbour", "harbor", "pipeline", "power plant", "nuclear plant", "radar station", "satellite station"],
    "conflict_zone": ["encounter", "operation", "exchange of fire", "gunfight", "bomb blast", "attack", "infiltration"],
    "diplomatic_location": ["embassy", "consulate", "high commission", "summit venue", "bilateral meeting"],
}
BORDER_STATES = ["Ladakh", "Jammu & Kashmir", "Arunachal Pradesh", "Sikkim", "Punjab", "Rajasthan"]

TARGETS = {
    "Military": ["army", "navy", "air force", "iaf", "drdo", "troops", "commanders", "corps"],
    "Government": ["government", "ministry", "minister", "parliament", "pib", "cabinet", "pm modi", "rajnath"],
    "Country": ["china", "pakistan", "united states", "russia", "bilateral", "foreign"],
    "Policy": ["procurement", "policy", "treaty", "deal", "budget", "agreement", "scheme"],
    "Event": ["encounter", "clash", "exercise", "patrol", "blast", "incident", "strike"],
}

# Organisations that texts name.
ORGANIZATIONS = [
    "Indian Army", "Indian Navy", "Indian Air Force", "IAF", "Coast Guard", "Indian Coast Guard", "CRPF", "BSF",
    "SSB", "ITBP", "CISF", "NSG", "SPG", "Para SF", "MARCOS", "Garud Commando Force", "Ministry of Defence",
    "MoD", "Ministry of External Affairs", "MEA", "Ministry of Home Affairs", "MHA", "DRDO", "HAL", "BEL", "BDL",
    "MDL", "GRSE", "BEML", "Hindustan Aeronautics Limited", "Bharat Electronics Limited",
    "Ordnance Factory Board", "OFB", "ISRO", "NSCS", "National Security Council", "RAW", "IB",
    "Intelligence Bureau", "NATO", "United Nations", "UN", "UN Security Council", "UNSC", "European Union", "EU",
    "SCO", "BRICS", "Quad", "AUKUS", "ASEAN", "SAARC", "PLA", "People's Liberation Army", "US Army", "US Navy",
    "US Air Force", "USAF", "Pentagon", "CIA", "FBI", "Pakistan Army", "ISI", "MI6", "Boeing", "Lockheed Martin",
    "Raytheon", "Northrop Grumman", "General Dynamics", "BAE Systems", "Dassault Aviation", "Thales", "MBDA",
    "Saab", "Leonardo", "Airbus", "Rosoboronexport", "Rostec", "Rafael", "Elbit Systems",
    "Israel Aerospace Industries", "IAI", "ORF", "Observer Research Foundation", "IDSA", "VIF", "Gateway House",
    "IISS", "RAND Corporation", "Brookings Institution", "SIPRI", "PIB", "Press Information Bureau", "ANI",
]

# Equipment by group.
EQUIPMENT = {
    "fighter_aircraft": [
        "Rafale", "Tejas", "MiG-21", "MiG-29", "Su-30MKI", "Su-30", "Mirage 2000", "Jaguar", "F-16", "F-35", "F-18",
        "F/A-18", "J-20", "J-10", "JF-17", "HAL Tejas", "AMCA", "Advanced Medium Combat Aircraft",
    ],
    "missiles": [
        "BrahMos", "Agni", "Agni-I", "Agni-II", "Agni-III", "Agni-IV", "Agni-V", "Agni-VI", "Prithvi", "Aakash",
        "Nag", "Helina", "MRSAM", "LRSAM", "Barak", "S-400", "Patriot", "THAAD", "HIMARS", "ATACMS", "Tomahawk",
        "Spike", "Javelin", "PJ-10", "YJ-12",
    ],
    "naval_vessels": [
        "INS Vikrant", "INS Vikramaditya", "INS Arihant", "INS Arighat", "INS Vishal", "INS Chennai", "INS Kolkata",
        "INS Delhi", "INS Kamorta", "INS Kiltan", "INS Kadmatt", "aircraft carrier", "destroyer", "frigate",
        "corvette", "submarine", "nuclear submarine", "SSBN", "SSN",
    ],
    "drones_uav": [
        "MQ-9", "MQ-9B", "Predator", "Global Hawk", "Heron", "Searcher", "Rustom", "TAPAS", "Ghatak", "Wing Loong",
        "MALE UAV", "UCAV", "Drone", "UAV", "UAS", "Kamikaze drone", "Loitering munition",
    ],
    "tanks_armour": [
        "Arjun", "Arjun MBT", "T-72", "T-90", "T-90S", "BMP-2", "FICV", "M1 Abrams", "Leopard 2", "Type 99",
    ],
    "systems": [
        "S-400", "S-300", "Patriot", "Iron Dome", "Arrow", "NASAMS", "SPYDER", "Akash", "DRDO MRSAM",
    ],
}

# Countries that texts name.
COUNTRIES = [
    "India", "China", "Pakistan", "Russia", "United States", "USA", "France", "Israel", "Japan", "Australia",
    "United Kingdom", "UK", "Germany", "Italy", "Spain", "South Korea", "North Korea", "Iran", "Saudi Arabia",
    "UAE", "Turkey", "Bangladesh", "Nepal", "Sri Lanka", "Maldives", "Bhutan", "Myanmar", "Afghanistan",
    "Indonesia", "Vietnam", "Philippines", "Thailand", "Malaysia", "Singapore", "Taiwan",
]

# Further countries where places are sought.
MORE_COUNTRIES = [
    "Ukraine", "Canada", "Egypt",
]

# Other names of places.
ALIASES = {
    "bombay": "Mumbai",
    "madras": "Chennai",
    "calcutta": "Kolkata",
    "bangalore": "Bengaluru",
    "poona": "Pune",
    "baroda": "Vadodara",
    "cawnpore": "Kanpur",
    "allahabad": "Prayagraj",
    "benares": "Varanasi",
    "mussoorie": "Mussoorie",
    "simla": "Shimla",
    "ooty": "Ooty",
    "pondicherry": "Puducherry",
    "trivandrum": "Thiruvananthapuram",
    "cochin": "Kochi",
    "calicut": "Kozhikode",
    "trichur": "Thrissur",
    "coimbatore": "Coimbatore",
    "trichy": "Tiruchirappalli",
    "tiruchirappalli": "Tiruchirappalli",
    "ahmednagar": "Ahilyanagar",
    "aurangabad": "Chhatrapati Sambhajinagar",
    "osmanabad": "Dharashiv",
    "ratnagiri": "Ratnagiri",
    "tamilnadu": "Tamil Nadu",
    "tamil nadu": "Tamil Nadu",
    "maharashtra": "Maharashtra",
    "andhra": "Andhra Pradesh",
    "telangana": "Telangana",
    "telengana": "Telangana",
    "uttaranchal": "Uttarakhand",
    "orissa": "Odisha",
    "j&k": "Jammu & Kashmir",
    "j & k": "Jammu & Kashmir",
    "jammu kashmir": "Jammu & Kashmir",
    "jammu and kashmir": "Jammu & Kashmir",
    "kashmeer": "Jammu & Kashmir",
    "kashmir": "Jammu & Kashmir",
    "ladak": "Ladakh",
    "arunachal": "Arunachal Pradesh",
    "chattisgarh": "Chhattisgarh",
    "chhattisgarh": "Chhattisgarh",
    "bengal": "West Bengal",
    "himachal": "Himachal Pradesh",
    "manipur": "Manipur",
    "loc": "Line of Control",
    "line of control": "Line of Control",
    "lac": "Line of Actual Control",
    "line of actual control": "Line of Actual Control",
    "imb": "Indo-Myanmar Border",
    "ib": "International Border",
}

# States and union territories of the home country.
STATES = [
    "Andhra Pradesh", "Arunachal Pradesh", "Assam", "Bihar", "Chhattisgarh", "Goa", "Gujarat", "Haryana",
    "Himachal Pradesh", "Jharkhand", "Karnataka", "Kerala", "Madhya Pradesh", "Maharashtra", "Manipur",
    "Meghalaya", "Mizoram", "Nagaland", "Odisha", "Punjab", "Rajasthan", "Sikkim", "Tamil Nadu", "Telangana",
    "Tripura", "Uttar Pradesh", "Uttarakhand", "West Bengal", "Jammu & Kashmir", "Ladakh", "Delhi", "Chandigarh",
    "Puducherry", "Dadra and Nagar Haveli and Daman and Diu", "Lakshadweep", "Andaman and Nicobar Islands",
]

# Cities by state.
CITIES = {
    "Maharashtra": ["Mumbai", "Pune", "Nagpur", "Nashik", "Aurangabad", "Chhatrapati Sambhajinagar", "Ahilyanagar", "Ahmednagar", "Kolhapur", "Solapur", "Nanded", "Amravati", "Thane", "Ratnagiri", "Sindhudurg", "Talegaon", "Deolali", "Kirkee", "Khadki"],
    "Tamil Nadu": ["Chennai", "Coimbatore", "Madurai", "Tiruchirappalli", "Salem", "Tirunelveli", "Vellore", "Wellington"],
    "Karnataka": ["Bengaluru", "Mysuru", "Hubballi", "Dharwad", "Belagavi"],
    "Rajasthan": ["Jaipur", "Jodhpur", "Udaipur", "Bikaner", "Alwar", "Kota", "Barmer", "Jaisalmer", "Pokhran", "Suratgarh"],
    "Punjab": ["Amritsar", "Ludhiana", "Chandigarh", "Pathankot", "Jalandhar", "Firozpur", "Bhatinda", "Adampur"],
    "Haryana": ["Gurugram", "Faridabad", "Ambala", "Hisar", "Sirsa"],
    "Delhi": ["Delhi", "New Delhi"],
    "Uttar Pradesh": ["Lucknow", "Agra", "Varanasi", "Prayagraj", "Kanpur", "Mathura", "Meerut", "Bareilly"],
    "Gujarat": ["Ahmedabad", "Surat", "Vadodara", "Rajkot", "Porbandar", "Bhuj", "Jamnagar", "Kandla"],
    "Madhya Pradesh": ["Bhopal", "Indore", "Jabalpur", "Gwalior", "Sagar"],
    "Himachal Pradesh": ["Shimla", "Dharamsala", "Manali", "Spiti", "Kullu"],
    "Uttarakhand": ["Dehradun", "Haridwar", "Rishikesh", "Nainital", "Roorkee"],
    "Jammu & Kashmir": ["Srinagar", "Jammu", "Anantnag", "Kupwara", "Poonch", "Rajouri", "Baramulla", "Pulwama", "Sopore", "Bandipora"],
    "Ladakh": ["Leh", "Kargil", "Diskit", "Siachen", "Daulat Beg Oldie"],
    "Sikkim": ["Gangtok", "Namchi"],
    "West Bengal": ["Kolkata", "Siliguri", "Darjeeling", "Jalpaiguri", "Asansol"],
    "Assam": ["Guwahati", "Dibrugarh", "Jorhat", "Tezpur", "Silchar"],
    "Manipur": ["Imphal", "Churachandpur", "Moreh", "Bishnupur"],
    "Meghalaya": ["Shillong", "Tura"],
    "Nagaland": ["Kohima", "Dimapur"],
    "Arunachal Pradesh": ["Itanagar", "Tawang", "Aalo"],
    "Mizoram": ["Aizawl"],
    "Tripura": ["Agartala"],
    "Telangana": ["Hyderabad", "Secunderabad"],
    "Andhra Pradesh": ["Visakhapatnam", "Vishakhapatnam", "Vizag", "Guntur", "Vijayawada"],
    "Kerala": ["Thiruvananthapuram", "Kochi", "Kozhikode", "Thrissur"],
    "Goa": ["Panaji", "Vasco da Gama", "Margao"],
    "Bihar": ["Patna", "Gaya", "Muzaffarpur"],
    "Jharkhand": ["Ranchi", "Jamshedpur"],
    "Odisha": ["Bhubaneswar", "Cuttack", "Puri", "Chandipur"],
    "Chhattisgarh": ["Raipur", "Bilaspur", "Bastar"],
}

# Strategic places: type, state, country (None: the home country, if there is a state).
STRATEGIC = {
    "Nathu La": ("border_pass", "Sikkim", None),
    "Jelep La": ("border_pass", "Sikkim", None),
    "Tawang": ("border_area", "Arunachal Pradesh", None),
    "Bumla": ("border_pass", "Arunachal Pradesh", None),
    "Depsang": ("border_area", "Ladakh", None),
    "Galwan Valley": ("border_area", "Ladakh", None),
    "Pangong Lake": ("border_area", "Ladakh", None),
    "Pangong Tso": ("border_area", "Ladakh", None),
    "Hot Springs": ("border_area", "Ladakh", None),
    "Gogra": ("border_area", "Ladakh", None),
    "Daulat Beg Oldie": ("military_airstrip", "Ladakh", None),
    "Siachen Glacier": ("military_position", "Ladakh", None),
    "Saltoro Ridge": ("military_position", "Ladakh", None),
    "Uri": ("border_area", "Jammu & Kashmir", None),
    "Balakot": ("military_target", None, "Pakistan"),
    "NDA Pune": ("military_academy", "Maharashtra", None),
    "Khadakwasla": ("military_academy", "Maharashtra", None),
    "IMA Dehradun": ("military_academy", "Uttarakhand", None),
    "INS Vikrant": ("naval_vessel", None, None),
    "INS Vikramaditya": ("naval_vessel", None, None),
    "INS Arihant": ("submarine", None, None),
    "Eastern Naval Command": ("military_headquarters", "Andhra Pradesh", None),
    "Western Naval Command": ("military_headquarters", "Maharashtra", None),
    "Southern Naval Command": ("military_headquarters", "Kerala", None),
    "Western Air Command": ("military_headquarters", "Delhi", None),
    "Eastern Air Command": ("military_headquarters", "Assam", None),
    "Pokhran": ("military_test_range", "Rajasthan", None),
    "Chandipur": ("missile_test_range", "Odisha", None),
    "Sriharikota": ("space_launch_facility", "Andhra Pradesh", None),
    "Abdul Kalam Island": ("missile_test_range", "Odisha", None),
    "Moreh": ("border_town", "Manipur", None),
    "Zokhawthar": ("border_town", "Mizoram", None),
    "Dawki": ("border_crossing", "Meghalaya", None),
    "Andaman Islands": ("strategic_island", "Andaman and Nicobar Islands", None),
    "Car Nicobar": ("military_base", "Andaman and Nicobar Islands", None),
    "INS Baaz": ("naval_air_station", "Andaman and Nicobar Islands", None),
    "Lakshadweep": ("strategic_island", "Lakshadweep", None),
}

# Regions and their states; of a state in several the last counts.
REGIONS = {
    "Northeast India": ["Assam", "Meghalaya", "Manipur", "Nagaland", "Tripura", "Mizoram", "Arunachal Pradesh", "Sikkim"],
    "Western Himalayas": ["Ladakh", "Jammu & Kashmir", "Himachal Pradesh", "Uttarakhand"],
    "Eastern Himalayas": ["Sikkim", "Arunachal Pradesh", "West Bengal"],
    "Western India": ["Rajasthan", "Gujarat", "Maharashtra", "Goa"],
    "Southern India": ["Tamil Nadu", "Kerala", "Karnataka", "Andhra Pradesh", "Telangana", "Puducherry"],
    "North India": ["Punjab", "Haryana", "Delhi", "Uttar Pradesh", "Bihar", "Chandigarh"],
    "Central India": ["Madhya Pradesh", "Chhattisgarh"],
    "Eastern India": ["West Bengal", "Jharkhand", "Odisha"],
    "Indo-Pacific": [],
    "Indian Ocean Region": [],
    "Line of Actual Control": [],
    "Line of Control": [],
}

# Patterns of regions in lower-case text, beside those of the states found.
REGION_PATTERNS = {
    "Northeast India": ["northeast india", "north east india", "northeastern india"],
    "Western Himalayas": ["western himalayas", "ladakh region"],
    "Eastern Himalayas": ["eastern himalayas", "eastern himalaya"],
    "Line of Actual Control": ["line of actual control", r"\blac\b"],
    "Line of Control": ["line of control", r"\bloc\b"],
    "Indo-Pacific": ["indo-pacific"],
    "Indian Ocean Region": ["indian ocean region", r"\bior\b"],
}

# Severity: patterns of procurement and what they say.
PROCUREMENT = {
    r"\b(?:javelin\s+anti-tank\s+missiles|javelin\s+missiles\s+to\s+be\s+made\s+in\s+india|co-produce\s+javelin|buy\s+us.*javelin)\b": "Indian defence acquisition / co-production of Javelin systems",
    r"\b(?:hal.*safran|safran\s+seal\s+deal|helicopter\s+engine|propulsion\s+systems\s+for\s+navy|ink\s+pact.*navy)\b": "Strategic Indian defence industrial partnership / engine development",
    r"\b(?:transfer\s+of\s+missile\s+technology\s+to\s+defence\s+industry|tata\s+advanced\s+systems.*mou)\b": "Indian missile technology transfer / industrial MoU",
    r"\b(?:defence\s+acquisition\s+council|dac\s+approves|defence\s+procurement\s+deal|make\s+in\s+india\s+defence)\b": "MoD / DAC capital acquisition milestone",
}

# Severity: critical patterns.
CRITICAL = {
    r"\b(?:cross[- ]border\s+firing|ceasefire\s+violation|mortar\s+shelling)\b": "Cross-border firing / ceasefire violation on frontier",
    r"\b(?:terrorists?|militants?|infiltrators?)\s+(?:killed|gunned down|neutralised|shot dead)\b": "Terrorists / infiltrators neutralised in counter-terror operation",
    r"\b(?:encounter|gunfight)\s+(?:breaks out|underway|in\s+(?:kashmir|j&k|jammu|rajouri|poonch|baramulla|kupwara|doda|kishtwar|kulgam|shopian|pulwama|srinagar|manipur))\b": "Active armed encounter / gunfight on frontier",
    r"\b(?:army\s+jawan|soldier|crpf|security\s+personnel)\s+(?:martyred|killed\s+in\s+action|shot\s+at)\b": "Armed attack on Indian security personnel",
    r"\b(?:ied\s+blast|bomb\s+blast|ambush\s+on\s+(?:army|crpf|security|convoy))\b": "IED / bomb blast / ambush on security forces",
    r"\b(?:standoff|clash|aggression)\s+at\s+lac\b": "Armed standoff / confrontation along LAC",
    r"\b(?:kukis?|meiteis?|nagas?)\s+(?:gunned down|ambushed|killed\s+in\s+firing|set ablaze)\b": "Lethal insurgent armed violence in Manipur sector",
    r"\btheft\s+of\s+firearms\s+including.*ak-203.*army\s+establishment\b": "Critical security breach: theft of assault rifles from Army establishment",
    r"\boperation\s+sindoor.*(?:cyber\s+terrorism|loitering\s+munition)\b": "High-level counter-terrorism / strategic defence operation",
}

# Severity: high patterns.
HIGH = {
    r"\b(?:war-like\s+stores|arms\s+cache\s+recovered|terror\s+hideout\s+busted)\b": "Recovery of border arms cache / hostile terror hideout",
    r"\b(?:hostile\s+drone\s+(?:intercepted|shot\s+down)|spy\s+drone\s+intercepted)\b": "Hostile border drone interception",
    r"\b(?:troop\s+buildup|forward\s+deployment)\s+at\s+lac\b": "Strategic forward troop deployment at LAC",
    r"\bindian\s+army\s+pilots\s+pull\s+off\s+daring\s+rescue\b": "High-altitude tactical aviation operation by Indian Army",
    r"\b(?:drdo\s+(?:flight\s+test|missile\s+launch)|agni-v\s+test|pralay\s+launch)\b": "Strategic Indian deterrent flight test",
}

# Severity: moderate patterns.
MODERATE = {
    r"\b(?:joint\s+military\s+exercise|yudh\s+abhyas|malabar\s+exercise|varuna\s+exercise)\b": "Joint military exercise",
    r"\b(?:border\s+roads\s+organisation|bro\s+tunnel|strategic\s+tunnel)\b": "Strategic border infrastructure",
    r"\b(?:rajnath\s+singh\s+reviews|defence\s+psus)\b": "MoD review of defence public sector undertakings",
    r"\b(?:jammu\s+and\s+kashmir\s+gets\s+new\s+intelligence\s+chief)\b": "Security intelligence leadership transition in J&K",
}

# Severity: civic and commercial words.
CIVIC = [
    "gold rate", "silver rate", "petrol price", "diesel price", "sensex", "nifty", "stock market", "box office",
    "trailer", "movie review", "cricket", "ipl", "t20", "film festival", "weather update", "heavy rain",
    "monsoon", "train ticket", "special train", "ganpati", "onam", "horoscope", "astrology", "custody dispute",
    "high court", "supreme court", "commercial matcha", "tea families", "waterlogging", "delhi voter rolls",
    "plastic currency", "liverpool", "sunderland", "man utd", "ac milan", "dolphins roster", "us open", "farke",
    "arteta", "roster cut", "sugar stock limit", "isabgol trade", "bpsc controller", "kpsc row",
    "kpsc recruitment", "haldwani", "purification row", "casteist", "black money in world",
    "class 10, 12 marksheets", "drop fail", "keralam islamic scholar", "stays at home", "sonam wangchuk",
    "potato in aluminium", "unusual black hole", "escape velocity", "traffic jam", "challan", "toll plaza",
    "inflation rate", "gdp growth", "marathon", "beed mother", "prize money", "daughters", "education",
    "miley cyrus", "dolly parton", "rural waste", "waste management", "transfer deadline", "winger azeez",
    "f1 q&a", "piastri", "norris", "medical interns protest", "stipend",
]

# Severity: crime and accidents.
CRIME = [
    "cracker factory", "ransom", "contract killing", "liquor scam", "rape", "pocso", "molestation", "dowry",
    "cheating", "bribe", "local police", "drown", "road accident", "bus accident", "theft of gold",
    "cyber fraud", "illegal construction", "challan", "body in suitcase", "mine sealing in raniganj",
    "crane overturns", "fire at mumbai port", "drowning near thane", "challans in july", "eve teasing",
    "property dispute",
]

# Severity: foreign conflicts.
FOREIGN = [
    "kyiv", "ukraine", "russia", "zelensky", "putin", "moscow", "gaza", "israel", "hamas", "hezbollah",
    "lebanon", "us election", "trump", "harris", "biden", "iran", "tehran", "red sea", "houthis", "yemen",
    "sudan", "taiwan", "philippines", "syria", "damascus", "kathmandu", "nepal flood", "nepal-china border",
    "bangladesh", "yunus", "sheikh hasina", "us-canada trade war", "us army secretary resigns",
    "ai surveillance network facing", "white house", "pentagon", "foreign ministry of china",
]

# Severity: domestic politics.
POLITICS = [
    "pm modi at sco", "indus water treaty", "indus waters treaty", "political unity in kashmir",
    "dialogue, not battlefield", "election rally", "assembly poll", "seat sharing", "cabinet approves",
    "gen z for change", "by-election", "byelections to", "census in manipur", "census 2027", "naga mlas write",
    "mines law amendment", "rebel trinamool mps", "pellet use during student", "major rishabh sambyal",
    "national crush", "kashmiri pandits seek security review", "threat letter with details",
    "case to be reopened", "historical case",
]

# Labels of the classifier.
CATEGORIES = [
    "Defence", "Military Affairs", "National Security", "Geopolitics", "International Relations",
    "Foreign Policy", "Border Security", "Internal Security", "Terrorism and Insurgency", "Defence Technology",
    "Cybersecurity", "Defence Procurement", "Military Exercise", "Strategic Infrastructure", "Maritime Security",
    "Aerospace and Aviation", "Space and Defence", "Diplomatic Affairs", "Strategic Affairs",
]

# Sub-categories by label.
SUB_CATEGORIES = {
    "Defence": ["Defence Procurement", "Military Exercise", "Air Defence", "Land Forces", "Defence Infrastructure", "Defence Manufacturing"],
    "Military Affairs": ["Indian Army", "Indian Navy", "Indian Air Force", "Joint Operations", "Military Leadership"],
    "International Relations": ["India-China Relations", "India-Pakistan Relations", "India-US Relations", "Indo-Pacific Strategy"],
    "Geopolitics": ["South Asian Security", "Regional Conflicts", "Territorial Disputes", "Strategic Alliances"],
    "National Security": ["Border Security", "Counterterrorism", "Critical Infrastructure", "Internal Security"],
    "Terrorism and Insurgency": ["Kashmir Security", "Northeast Frontier", "Cross-border Terrorism", "Internal Disturbance"],
    "Defence Technology": ["Missiles", "Fighter Aircraft", "Drones and UAVs", "Naval Vessels", "Radar Systems", "Electronic Warfare"],
    "Cybersecurity": ["Cyber Defence", "Critical Network Security", "Digital Surveillance"],
    "Defence Procurement": ["Capital Acquisition", "Make in India Defence", "Defence Contracts", "Arms Imports"],
    "Maritime Security": ["Indian Ocean Domain", "Coastal Security", "Naval Patrol", "SLOC Protection"],
}

# Words that queries leave out.
STOPWORDS = [
    "a", "an", "the", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were",
    "be", "been", "being", "have", "has", "had", "what", "where", "when", "who", "which", "how", "why", "show",
    "me", "tell", "about", "current", "situation", "status", "news", "articles", "happening", "this", "that",
    "these", "those", "and", "or", "not", "please", "some", "updates", "update", "latest", "recent", "report",
    "reports", "today", "yesterday", "live", "highlights", "summary", "information", "details", "brief",
    "article", "regarding", "find", "get", "give", "overview",
]

# Sectors of the map: x, y, coordinates.
SECTORS = {
    "Ladakh": (48.5, 22.0, "34.1526° N, 77.5771° E"),
    "Jammu & Kashmir": (45.0, 24.5, "33.3765° N, 74.3106° E"),
    "Punjab": (44.0, 29.5, "31.6340° N, 74.8723° E"),
    "Rajasthan": (41.0, 37.0, "27.5530° N, 76.6346° E"),
    "Maharashtra": (43.5, 56.5, "18.5204° N, 73.8567° E"),
    "Manipur": (68.0, 43.5, "24.8170° N, 93.9368° E"),
    "Sikkim": (62.5, 36.5, "27.3389° N, 88.6065° E"),
    "Arunachal Pradesh": (66.5, 35.0, "27.5861° N, 91.8654° E"),
    "Assam": (65.0, 38.5, "26.1445° N, 91.7362° E"),
    "Tamil Nadu": (48.0, 67.0, "13.0827° N, 80.2707° E"),
    "Andhra Pradesh": (52.5, 54.0, "17.6868° N, 83.2185° E"),
    "Kerala": (46.5, 70.0, "10.8505° N, 76.2711° E"),
    "Delhi": (46.0, 33.0, "28.6139° N, 77.2090° E"),
    "Uttar Pradesh": (50.0, 36.0, "26.8467° N, 80.9462° E"),
    "Odisha": (56.0, 47.0, "20.9517° N, 85.0985° E"),
    "Gujarat": (38.0, 44.0, "22.2587° N, 71.1924° E"),
    "West Bengal": (60.0, 42.0, "22.5726° N, 88.3639° E"),
    "Andaman and Nicobar Islands": (72.0, 69.5, "11.6234° N, 92.7265° E"),
    "Telangana": (49.0, 51.0, "17.3850° N, 78.4867° E"),
    "Karnataka": (45.0, 61.0, "12.9716° N, 77.5946° E"),
}

