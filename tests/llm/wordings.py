"""Residue in wordings that no list of the operator has word for word, written before its lists of parts; and sentences that only sound like it."""

HELD_BACK = {
    "script": [
        "JavaScript seems to be disabled in your browser.", "Please switch JavaScript on to continue.", "This application cannot run without JavaScript.",
        "JavaScript must be activated to view this content.", "Your browser is blocking scripts.", "Turn JavaScript on and reload the page.",
        "Scripts are blocked on this page.", "Für diese Seite muss JavaScript eingeschaltet sein.", "JavaScript wird benötigt, um diese Seite anzuzeigen.",
        "JavaScript est nécessaire pour afficher cette page.", "Merci d'autoriser JavaScript dans votre navigateur.",
        "Para ver esta página es necesario JavaScript.", "Debe habilitar JavaScript para continuar.",
    ],
    "error": [
        "Oops! We hit a snag loading this page.", "Sorry, we couldn't find that page.", "The page you requested has been moved or deleted.",
        "We're having trouble loading this content right now.", "Unable to connect to the server.", "You are not authorized to view this page.",
        "The request could not be completed.", "This link has expired.", "The server is currently overloaded. Try again in a few minutes.",
        "Failed to load transcript.", "Diese Seite konnte nicht geladen werden.", "Etwas ist schiefgelaufen.",
        "Sie sind nicht berechtigt, diese Seite zu öffnen.", "Impossible de charger cette page.", "Cette page n'est plus disponible.",
        "Algo salió mal.", "No se pudo cargar la página.", "La página que busca ya no está disponible.",
    ],
    "filler": [
        "This section has not been written yet.", "Este contenido estará disponible pronto.", "Text goes in this space.", "Description will be added soon.",
        "Replace me with real content.", "More information coming soon.", "Dieser Abschnitt wird noch ergänzt.", "Hier kommt noch Text hin.",
        "Cette section sera complétée prochainement.", "Texte à compléter.", "Contenido pendiente.", "Sección en construcción.",
    ],
}
REAL = [
    "I couldn't load the page on my phone, so I called the shop.", "She said the page was not found and laughed.", "We had to enable JavaScript in it.",
    "The server brought our soup and it was cold.", "He was not available for comment on Tuesday.", "The link is in the description below.",
    "The talk explains what to do when a request times out.", "Most people turn scripts off to read faster.", "Their session on gardening has been moved to room five.",
    "The video shows how the section was written.", "My account of the trip will be added to the book.", "Access to the cave was denied to all visitors in winter.",
    "We ran into a problem with the oven and had to start again.", "Er sagte, die Seite sei nicht gefunden worden.", "Le texte a été écrit par un ami.",
    "El contenido del libro no está mal.", "10:14:02 WARN could not connect to the server, retry 3", "More on this after the break, coming soon to a theater near you.",
    "The error was mine, and the text goes on for pages.", "Try again in a few minutes, said the coach, and we did.",
]
