"""Word lists about names. Fixed values, each list stated plainly."""

#: Given names in use in many countries.
GIVEN_NAMES = """
Aisha Alexander Alice Ana Andrew Anna Anouk Arjun Ayesha Barbara Beatriz Benjamin Birgit Bruno Camille Carlos Carmen
Charlotte Chiara Christopher Daniel Dariusz David Deepa Diego Dmitri Dorothea Edward Eleanor Elena Elizabeth Emeka Emily
Emma Erik Esther Eva Farid Fatima Felix Francisco Frederick Gabriela Giovanni Goran Greta Hana Hannah Hassan Helena Hugo
Ibrahim Ilse Ingrid Isabella Ivan Ivo James Jennifer Joaquin Johannes John Jonas Josefina Julia Kaori Karim Katherine
Kenji Kwame Lars Laura Leila Leonard Lucia Luis Magnus Margaret Maria Marta Martin Matthias Mehmet Mei-Lin Michael Milan
Mohammed Nadia Nicholas Nils Noor Olga Olivia Omar Otto Patricia Pavel Pedro Peter Petra Priya Quentin Rania Richard
Robert Rosa Ruben Samuel Sarah Silke Sofia Soren Stefan Susanna Tamsin Tariq Theodore Thomas Tomas Ulrike Uma Victor
Victoria Vikram Viola Wanda Wilhelmina William Wim Xenia Yara Yusuf Zeno Zofia
""".split()

#: Short forms, each with its full names.
NICKNAMES = {
    "Alexander": "Alex Xander Sasha Sandy Lex",
    "Andrew": "Andy Drew",
    "Benjamin": "Ben Benny Benji",
    "Christopher": "Chris Kit Topher",
    "Dorothea": "Dora Thea Dot Dorrie",
    "Edward": "Ed Eddie Ned Teddy Ted",
    "Eleanor": "Ellie Nell Nora Ella",
    "Elizabeth": "Liz Lizzie Beth Betty Eliza Betsy Libby",
    "Francisco": "Paco Fran Pancho Curro",
    "Frederick": "Fred Freddie Freddy Fritz",
    "Gabriela": "Gabi Gaby Ela",
    "Isabella": "Bella Isa Izzy",
    "Jennifer": "Jen Jenny Jenn",
    "Johannes": "Hannes Hans Jo",
    "Josefina": "Fina Pepa Josie",
    "Katherine": "Kate Kathy Katie Kat Kitty",
    "Leonard": "Leo Len Lenny",
    "Margaret": "Maggie Meg Peggy Marge Madge",
    "Matthias": "Matti Hias Matt",
    "Michael": "Mike Mick Micky Mikey",
    "Nicholas": "Nick Nico Nicky",
    "Richard": "Rick Dick Rich Ricky Richie",
    "Robert": "Bob Bobby Rob Robbie Bert",
    "Samuel": "Sam Sammy",
    "Susanna": "Sue Susi Susie Suzy Sanna",
    "Theodore": "Ted Theo Teddy",
    "Thomas": "Tom Tommy",
    "Victoria": "Vicky Vic Tori Vicki",
    "Wilhelmina": "Mina Willa Minnie Wilma Helma",
    "William": "Will Bill Billy Willy Liam",
}

#: Titles before a name.
TITLES = "dr prof mr mrs ms miss mx sir herr frau fr hr don dona sr sra señor señora dipl ing phd professor doctor".split()

#: Legal forms of organisations.
LEGAL_FORMS = (
    "inc incorporated llc ltd limited gmbh ag aktiengesellschaft sa co company corp corporation plc bv nv oy ab kg se spa srl pty "
    "gesellschaft sociedad anonima societe anonyme"
).split()

#: Words of organisation names, each with its short forms.
ORGANISATION_WORDS = {
    "associates": "assoc assocs associates associate",
    "brothers": "bros brothers",
    "consulting": "consulting cons",
    "group": "group grp",
    "data": "data",
    "analytics": "analytics",
    "engineering": "engineering eng engrg",
    "instruments": "instruments instr instrument",
    "international": "international intl int",
    "laboratories": "laboratories labs lab laboratory",
    "logistics": "logistics log logist",
    "manufacturing": "manufacturing mfg manuf",
    "pharmaceuticals": "pharmaceuticals pharma pharm",
    "research": "research res",
    "institute": "institute inst",
    "systems": "systems sys system",
    "technologies": "technologies tech techs technology",
    "university": "university univ uni",
    "foundation": "foundation fdn",
    "partners": "partners ptnrs",
    "holdings": "holdings hldgs",
    "solutions": "solutions soln",
    "services": "services svcs svc",
    "industries": "industries ind inds",
    "bank": "bank bk",
}

#: Marks of names that are neither a person nor an organisation.
OTHER_KINDS = r"^project\s|-cli$|\sranking$|\shall$"
