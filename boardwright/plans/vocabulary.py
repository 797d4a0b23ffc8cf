"""A small vocabulary in the words of the test tables; users bring their own."""

from boardwright.operators.classify import Vocabulary

POSTINGS = Vocabulary(
    core=("javascript developer", "machine learning engineer", "database architect", "network administrator", "system analyst", "cyber security analyst"),
    other=("web designer", "data entry operator", "programme coordinator"),
    generic=("project associate", "technical assistant", "young professional", "apprentice", "junior engineer"),
    exclude=("staff nurse", "cook", "tram conductor", "forest guard", "result of", "selection list", "hostel warden"),
    wanted_urls=("software", "notice", "view", "it"),
    unwanted_urls=("uploads",),
    wanted_profile=("computer", "software", "system", "data", "server", "network", "analysis"),
    unwanted_profile=("medical", "veterinary", "sanitary", "loading", "library", "museum"),
    first_orgs=("lab_nisrolmaium", "psu_fekritvakayan", "mission_sampetinayan"),
    overrides=(("lab_rokfetpiium", " surveyor ", "excluded"), ("univ_memlemisova", " under project ", "relevant")),
)
